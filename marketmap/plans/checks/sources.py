"""Checks for SRC1-12 and RTY1-2 (state reads and writes)."""

import uuid

from pyspark.sql import functions as F

from marketmap.sources import companies as C
from marketmap.sources import export as X
from marketmap.sources import state as S
from marketmap.sources import taxonomy_store as TS
from marketmap.plans.registry import register
from marketmap.session import state_root

# DuckDB spelling of the shared text rules (ASCII inputs).
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def slug_sql(x: str) -> str:
    return (f"regexp_replace(lower(regexp_replace(upper({x}), "
            r"'\b(?:HOLDINGS|LIMITED|GROUP|LTD|PLC|LLP)\b', ' ', 'g')), '[^a-z0-9]', '', 'g')")


CLEAN_SQL = f"""select input_seq, nullif({strip_sql('company_number')}, '') as company_number,
  coalesce({strip_sql('company_name')}, '') as company_name,
  nullif({strip_sql('postcode')}, '') as postcode
from v_companies_raw where coalesce({strip_sql('company_name')}, '') <> ''"""

KEYS_SQL = f"""select input_seq, coalesce(company_number, case when {slug_sql('company_name')} <> ''
  then 'slug:' || substr({slug_sql('company_name')}, 1, 40)
  else 'hash:' || substr(md5(company_name), 1, 16) end) as company_number,
  company_name, postcode from clean"""

DEDUP_SQL = """select company_number, input_seq, company_name, postcode from (
  select *, row_number() over (partition by company_number order by input_seq) as rn from keys) z
  where rn = 1"""

# CTE prefix other checks reuse: clean -> keys -> companies.
COMPANIES_CTES = f""", clean as ({CLEAN_SQL}), keys as ({KEYS_SQL}), companies as ({DEDUP_SQL})"""


def companies(fx):
    return C.load_companies(fx.view("v_companies_raw"))


@register("companies_clean", views=["v_companies_raw"], oracle=CLEAN_SQL)
def _clean(fx):
    return C.clean_companies(fx.view("v_companies_raw"))


@register("company_keys", views=["v_companies_raw"],
          oracle=f", clean as ({CLEAN_SQL})\n{KEYS_SQL}")
def _keys(fx):
    return C.key_companies(C.clean_companies(fx.view("v_companies_raw")))


@register("companies_dedup", views=["v_companies_raw"],
          oracle=f"{COMPANIES_CTES}\nselect * from companies")
def _dedup(fx):
    return companies(fx)


# ---- state ----

RESEARCH_STATE_SQL = """select company_number, company_name, cast(null as varchar) as postcode, domain,
  cast(null as varchar) as domain_confidence, cast(null as varchar) as domain_method,
  cast(null as int) as website_raw_text_length, services_description,
  cast(null as varchar[]) as specialisms, sector, cast(null as varchar) as sub_sector,
  cast(null as varchar) as classification_confidence, cast(null as varchar) as rationale,
  cast(null as varchar[]) as keywords, sampled_for_discovery, taxonomy_version_id, processed_at,
  error_log from v_research"""


@register("state_upsert", views=["v_research"], oracle=f"""
, st as ({RESEARCH_STATE_SQL}),
p as (select 1 as seq, * from st union all
      select 2, company_number, company_name, postcode, domain, domain_confidence, domain_method,
        website_raw_text_length, services_description, specialisms, cast(null as varchar),
        sub_sector, classification_confidence, rationale, keywords, 0, taxonomy_version_id,
        processed_at, error_log
      from st where company_number like '%1'),
last as (select * from (select *, row_number() over (partition by company_number order by seq desc) rn from p) z where rn = 1),
flag as (select company_number, max(sampled_for_discovery) as f from p group by company_number)
select last.company_number, company_name, postcode, domain, domain_confidence, domain_method,
  website_raw_text_length, services_description, specialisms, sector, sub_sector,
  classification_confidence, rationale, keywords, cast(coalesce(f, 0) as int) as sampled_for_discovery,
  taxonomy_version_id, processed_at, error_log
from last join flag on last.company_number = flag.company_number""")
def _upsert(fx):
    st = fx.view("v_research")
    replay = st.filter(F.col("company_number").endswith("1")) \
        .withColumn("sector", F.lit(None).cast("string")) \
        .withColumn("sampled_for_discovery", F.lit(0))
    return S.latest(S.make_patches(st, 1).unionByName(S.make_patches(replay, 2)))


MARK_KEYS_SQL = """select company_number from v_research where company_number like '%5'
  union all select company_number from v_lex_companies where cast(company_number as bigint) % 50 = 0"""


@register("mark_sampled", views=["v_research", "v_lex_companies"], oracle=f"""
, k as (select distinct company_number from ({MARK_KEYS_SQL}) z)
select coalesce(r.company_number, k.company_number) as company_number, r.company_name,
  cast(case when k.company_number is not null then 1 else r.sampled_for_discovery end as int)
    as sampled_for_discovery, r.sector
from v_research r full outer join k on r.company_number = k.company_number""")
def _mark(fx):
    keys = fx.sql(["v_research", "v_lex_companies"], MARK_KEYS_SQL)
    return S.mark_sampled(fx.view("v_research"), keys) \
        .select("company_number", "company_name", "sampled_for_discovery", "sector")


@register("resume_join", views=["v_companies_raw", "v_research"], oracle=f"""
{COMPANIES_CTES}
select c.company_number, c.company_name, r.domain as existing_domain,
  r.services_description as existing_services_description, r.sector as existing_sector,
  r.sampled_for_discovery as existing_sampled_for_discovery
from companies c left join v_research r on r.company_number = c.company_number""")
def _resume(fx):
    return S.resume_join(companies(fx), fx.view("v_research")).select(
        "company_number", "company_name", "existing_domain", "existing_services_description",
        "existing_sector", "existing_sampled_for_discovery")


EXPORT_SQL = f"""
, st as ({RESEARCH_STATE_SQL})
select company_number, company_name, postcode, domain, domain_confidence, domain_method,
  services_description, case when domain is not null then '["caf\\u00e9", "' || domain || '", "a\\\\b \\"c\\""]' end as specialisms, sector, sub_sector,
  classification_confidence, rationale, cast(null as varchar) as keywords, taxonomy_version_id,
  processed_at, error_log
from st order by company_name, company_number"""


@register("export_rows", views=["v_research"], oracle=EXPORT_SQL)
def _export(fx):
    lists = F.when(F.col("domain").isNotNull(),
                   F.array(F.lit("café"), F.col("domain"), F.lit('a\\b "c"')))
    return X.export_rows(fx.view("v_research").withColumn("specialisms", lists))


# ---- taxonomy versions (derived from the versions seen in the state) ----

VERSIONS_SQL = """select cast(taxonomy_version_id as int) as version_id,
  cast(count(*) as int) as company_count_used,
  case when taxonomy_version_id = 1 then 'initial' end as refresh_trigger,
  min(processed_at) as created_at,
  case when taxonomy_version_id > 1 then 'refresh from v' || cast(taxonomy_version_id - 1 as varchar) end as notes
from v_research where taxonomy_version_id is not null group by taxonomy_version_id"""


def versions(fx):
    return fx.sql(["v_research"], VERSIONS_SQL.replace("as varchar", "as string"))


@register("latest_version", views=["v_research"],
          oracle=f", ver as ({VERSIONS_SQL})\nselect max(version_id) as version_id from ver")
def _latest(fx):
    return TS.latest_version(versions(fx))


@register("taxonomy_history", views=["v_research"], oracle=f"""
, ver as ({VERSIONS_SQL})
select version_id, substr(cast(created_at as varchar), 1, 19) as created_at,
  coalesce(refresh_trigger, '') as refresh_trigger,
  coalesce(company_count_used, 0) as company_count_used, coalesce(notes, '') as notes
from ver order by version_id""")
def _history(fx):
    return TS.history(versions(fx))


@register("taxonomy_version_append", views=["v_taxonomy", "v_research"], oracle="""
, e as (select cast(count(*) as int) as n from v_research where sampled_for_discovery = 1
  and services_description is not null and services_description <> 'INSUFFICIENT_DATA')
select cast(1 as int) as version_id, n as company_count_used, 'initial' as refresh_trigger, '' as notes from e
union all select cast(2 as int), n, 'manual', 'refresh from v1' from e""")
def _append(fx):
    """SRC10: two appends (initial, then a refresh) into a fresh version folder."""
    spark = fx.spark
    path = state_root(spark, "checks", f"versions-{uuid.uuid4().hex}")
    doc = TS.to_json_text(TS.nest(fx.view("v_taxonomy")))
    eligible = fx.view("v_research").filter(
        (F.col("sampled_for_discovery") == 1) & F.col("services_description").isNotNull()
        & (F.col("services_description") != "INSUFFICIENT_DATA")).agg(F.count(F.lit(1)))
    TS.append_version(spark, path, doc, eligible, "initial")
    TS.append_version(spark, path, doc, eligible, "manual", change_log="[]",
                      notes="refresh from v1")
    return TS.read_versions(spark, path).select(
        "version_id", "company_count_used", "refresh_trigger", "notes")


# ---- retry ----

@register("errored", views=["v_research"], oracle="""
select company_number, company_name, cast(null as varchar) as postcode, error_log
from v_research where error_log is not null""")
def _errored(fx):
    from marketmap.operators.retry import errored
    return errored(fx.view("v_research"))


@register("error_cleared", views=["v_research"], oracle="""
select company_number, case when error_log is not null and company_number like '%0' then null
  else error_log end as error_log, sector
from v_research""")
def _error_cleared(fx):
    st = fx.view("v_research")
    keys = st.filter(F.col("error_log").isNotNull() & F.col("company_number").endswith("0"))
    return S.clear_error(st, keys).select("company_number", "error_log", "sector")
