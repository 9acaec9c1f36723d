"""Checks for MON1-9."""

from pyspark.sql import functions as F

from marketmap.operators import monitor as M
from marketmap.plans.checks.sources import VERSIONS_SQL, versions
from marketmap.plans.registry import register

_ROLLUP_SQL = """
select sector, count(*) as n, count(*) filter (where domain is not null) as n_domain,
  count(*) filter (where services_description is not null) as n_services,
  count(*) filter (where error_log is not null) as n_errored
from v_research group by sector"""

_SUMMARY_SQL = """
select cast(coalesce(sum(n), 0) as bigint) as total,
  cast(coalesce(sum(n_domain), 0) as bigint) as domain_found,
  cast(coalesce(sum(n_services), 0) as bigint) as services_extracted,
  cast(coalesce(sum(case when sector is not null and sector <> 'UNCLASSIFIED' then n end), 0) as bigint) as classified,
  cast(coalesce(sum(case when sector = 'UNCLASSIFIED' then n end), 0) as bigint) as unclassified,
  cast(coalesce(sum(n_errored), 0) as bigint) as errored
from r"""


@register("summary_counts", views=["v_research"], oracle=f"""
, r as ({_ROLLUP_SQL})
{_SUMMARY_SQL}""")
def _summary_counts(fx):
    return M.summary_counts(fx.view("v_research"))


@register("sector_counts", views=["v_research"], oracle="""
select sector, count(*) as n from v_research where sector is not null
group by sector order by n desc, sector limit 20""")
def _sector_counts(fx):
    return M.sector_counts(fx.view("v_research"), 20)


@register("status_shares", views=["v_research"], oracle=f"""
, r as ({_ROLLUP_SQL}), s as ({_SUMMARY_SQL})
select case when total > 0 then cast(100.0 as double) * unclassified / total end as unclassified_pct,
  domain_found / cast(greatest(total, 1) as double) as domain_share,
  classified / cast(greatest(total, 1) as double) as classified_share,
  unclassified / cast(greatest(total, 1) as double) as unclassified_share
from s""")
def _status_shares(fx):
    return M.status_shares(M.summary_counts(fx.view("v_research")))


STATUS_REPORT_SQL = f"""
, r as ({_ROLLUP_SQL}), s as ({_SUMMARY_SQL}), ver as ({VERSIONS_SQL}),
newest as (select * from ver order by version_id desc limit 1)
select 'summary' as section, item, n, cast(null as double) as pct from (
  select 'total' as item, total as n from s union all
  select 'domain_found', domain_found from s union all
  select 'services_extracted', services_extracted from s union all
  select 'classified', classified from s union all
  select 'unclassified', unclassified from s union all
  select 'errored', errored from s) x
union all
select 'sector', sector, n, cast(100.0 as double) * n / (select total from s) from (
  select sector, n from r where sector is not null order by n desc, sector limit 20) y
union all
select 'share', 'unclassified_pct', cast(null as bigint),
  case when total > 0 then cast(100.0 as double) * unclassified / total end from s
union all
select 'taxonomy', 'latest_version', cast(max(version_id) as bigint), cast(null as double) from ver
union all
select 'taxonomy_created', coalesce(substr(cast(created_at as varchar), 1, 19), '?'), cast(version_id as bigint), cast(null as double) from newest
union all
select 'taxonomy_trigger', coalesce(refresh_trigger, '?'), cast(version_id as bigint), cast(null as double) from newest
union all
select 'taxonomy', 'sectors', cast(count(distinct sector_pos) as bigint), cast(null as double)
from v_taxonomy"""


def status_report_query(fx):
    return M.status_report(fx.view("v_research"), fx.view("v_taxonomy"), 20, versions(fx))


register("status_report", views=["v_research", "v_taxonomy"],
         oracle=STATUS_REPORT_SQL)(status_report_query)


@register("rolling_unclassified", views=["v_research"], oracle="""
select count(*) filter (where sector = 'UNCLASSIFIED') as unclassified, count(*) as total
from (select sector from v_research where sector is not null
      order by processed_at desc nulls last, company_number limit 1000) z""")
def _rolling(fx):
    return M.rolling_unclassified(fx.view("v_research"), 1000)


# Rows since the last refresh = rows placed at the newest version in the state.
@register("refresh_trigger", views=["v_research"], oracle="""
, w as (select count(*) filter (where sector = 'UNCLASSIFIED') as unclassified, count(*) as total
  from (select sector from v_research where sector is not null
        order by processed_at desc nulls last, company_number limit 1000) z),
since as (select count(*) as c from v_research
  where taxonomy_version_id = (select max(taxonomy_version_id) from v_research))
select unclassified, total, cast(c as bigint) as rows_since_refresh,
  case when c >= 10000 then 'scheduled'
       when total >= 1000 and unclassified / cast(greatest(total, 1) as double) > 0.05
       then 'unclassified_threshold' end as trigger
from w, since""")
def _trigger(fx):
    st = fx.view("v_research")
    newest = st.agg(F.max("taxonomy_version_id").alias("taxonomy_version_id"))
    since = st.join(F.broadcast(newest), "taxonomy_version_id") \
        .agg(F.count(F.lit(1)).alias("rows_since_refresh"))
    return M.refresh_trigger(M.rolling_unclassified(st, 1000), since)


@register("spend", views=["v_calls"], oracle="""
, p as (select * from (values ('search', 24), ('small_model', 100), ('large_model', 1500)) t(service, unit_price_e5)),
per as (select service, count(*) as calls from v_calls group by service),
j as (select per.service, calls, unit_price_e5 from per join p on per.service = p.service)
select coalesce(service, 'total') as service, cast(sum(calls) as bigint) as calls,
  sum(calls * unit_price_e5) / cast(100000 as double) as gbp
from j group by rollup(service)""")
def _spend(fx):
    return M.spend(fx.view("v_calls"))


@register("run_counters", views=["v_calls"], oracle="""
select count(distinct company_id) as processed,
  count(distinct case when service in ('guess', 'search') and outcome = 'placed' then company_id end) as domains_found,
  count(*) filter (where service = 'failed') as errors
from v_calls""")
def _run_counters(fx):
    return M.run_counters(fx.view("v_calls"))


@register("time_per_company", views=["v_calls"], oracle="""
select (max(epoch_us(ts)) - min(epoch_us(ts))) / cast(1e6 as double) as elapsed_s,
  count(distinct company_id) as companies,
  case when count(distinct company_id) > 0 then
    (max(epoch_us(ts)) - min(epoch_us(ts))) / cast(1e6 as double) / count(distinct company_id) end
    as sec_per_company
from v_calls""")
def _time_per_company(fx):
    return M.time_per_company(fx.view("v_calls"))
