"""Checks for CLS1-10, RFR1-6, SMP1-4 and RTY3."""

import uuid

from pyspark.sql import functions as F

from marketmap.operators import classify as K
from marketmap.operators import refresh as R
from marketmap.operators import retry as RT
from marketmap.operators import sampling as SM
from marketmap.operators import taxonomy as T
from marketmap.operators.partitioning import attach_one_row
from marketmap.plans import modes
from marketmap.plans.checks.sources import COMPANIES_CTES, companies
from marketmap.plans.checks.taxonomy import ERRORS_SQL, terms_sql
from marketmap.plans.checks.text import postcode_area_sql
from marketmap.plans.registry import register
from marketmap.session import state_root
from marketmap.sources import state as S


@register("pending", views=["v_companies_raw", "v_research"], oracle=f"""{COMPANIES_CTES}
select company_number, input_seq from companies where company_number not in (
  select company_number from v_research where sector is not null or error_log is not null)""")
def _pending(fx):
    return K.pending(companies(fx), fx.view("v_research")).select("company_number", "input_seq")


@register("needs_services", views=["v_companies_raw", "v_research"], oracle=f"""{COMPANIES_CTES}
select c.company_number, r.company_number is null or r.services_description is null
  or r.services_description = '' or r.services_description = 'INSUFFICIENT_DATA' as needs_services
from companies c left join v_research r on r.company_number = c.company_number""")
def _needs(fx):
    return K.needs_services(companies(fx), fx.view("v_research")) \
        .select("company_number", "needs_services")


NO_DATA_WHERE = ("services_description is null or services_description = '' "
                 "or services_description = 'INSUFFICIENT_DATA'")


@register("classify_no_data", views=["v_lex_companies"], oracle=f"""
select company_number, 'UNCLASSIFIED' as sector, cast(null as varchar) as sub_sector,
  'LOW' as confidence, 'no services data' as rationale, cast(null as varchar[]) as keywords
from v_lex_companies where {NO_DATA_WHERE}""")
def _no_data(fx):
    return K.no_data_rule(fx.view("v_lex_companies"))


LEXICAL_TEMPLATE = f"""
, leaves as (select sector_pos, sub_pos, sector, sub_sector,
    {terms_sql("concat_ws(' ', coalesce(sector, ''), coalesce(sub_sector, ''), '', '')")} as t
  from {{tax}} where sub_pos is not null),
nl as (select count(*) as big_n from leaves),
lt as (select sector_pos, sub_pos, sector, sub_sector, unnest(t) as term from leaves),
dfq as (select term, count(*) as df from lt group by term),
terms as (select lt.term, sector_pos, sub_pos, sector, sub_sector,
  ln((big_n + 1) / (df + 1)) + 1 as weight from lt join dfq on dfq.term = lt.term, nl),
usable as (select company_number, services_description from {{comp}} where not ({NO_DATA_WHERE})),
ct as (select company_number, unnest({terms_sql("concat_ws(' ', services_description, '')")}) as term from usable),
m as (select ct.company_number, terms.* from ct join terms on terms.term = ct.term),
per as (select company_number, sector_pos, sub_pos, min(sector) as sector, min(sub_sector) as sub_sector,
  round(sum(weight), 6) as score, count(*) as shared,
  list(term order by weight desc, term)[1:3] as kw from m group by company_number, sector_pos, sub_pos),
best as (select * from (select *, row_number() over (partition by company_number
  order by score desc, shared desc, sector_pos, sub_pos) as r from per) z where r = 1)
select company_number, sector, sub_sector,
  case when shared >= 3 then 'HIGH' when shared = 2 then 'MEDIUM' else 'LOW' end as confidence,
  printf('matched %d taxonomy terms: %s', shared, array_to_string(kw, ', ')) as rationale,
  kw as keywords, score, shared from best
union all
select company_number, 'UNCLASSIFIED', null, 'LOW', 'no taxonomy terms matched', cast([] as varchar[]),
  cast(0 as double), cast(0 as bigint)
from usable where company_number not in (select company_number from best)
union all
select company_number, 'UNCLASSIFIED', null, 'LOW', 'no services data', null, null, null
from {{comp}} where {NO_DATA_WHERE}"""

LEXICAL_SQL = LEXICAL_TEMPLATE.replace("{tax}", "v_lex_taxonomy").replace("{comp}", "v_lex_companies")


@register("classify_lexical", views=["v_lex_companies", "v_lex_taxonomy"], oracle=LEXICAL_SQL)
def _lexical(fx):
    return K.classify_lexical(fx.view("v_lex_companies"), fx.view("v_lex_taxonomy"))


@register("classify_missing", views=["v_proposals"], oracle="""
select c.c_custkey as company_number, p.sector,
  case when p.company_number is null then 'classify: LLM returned nothing' end as error_log
from customer c left join v_proposals p on p.company_number = c.c_custkey""")
def _missing(fx):
    cust = fx.table("customer").select(F.col("c_custkey").alias("company_number"))
    return K.missing_responses(cust, fx.view("v_proposals"))


VALIDATED_SQL = """
, names as (select sector, min(sector_pos) as p from v_taxonomy where sector is not null group by sector),
pairs as (select distinct t.sector, t.sub_sector from v_taxonomy t join names n
  on n.sector = t.sector and n.p = t.sector_pos where t.sub_pos is not null),
validated as (select pr.company_number,
  case when pr.sector = 'UNCLASSIFIED' then pr.sector
       when n.sector is null or pa.sector is null then 'UNCLASSIFIED' else pr.sector end as sector,
  case when pr.sector = 'UNCLASSIFIED' or n.sector is null or pa.sector is null then null
       else pr.sub_sector end as sub_sector,
  case when pr.sector = 'UNCLASSIFIED' then pr.confidence
       when n.sector is null or pa.sector is null then 'LOW' else pr.confidence end as confidence
from v_proposals pr left join names n on n.sector = pr.sector
left join pairs pa on pa.sector = pr.sector and pa.sub_sector = pr.sub_sector)"""


@register("classify_validated", views=["v_proposals", "v_taxonomy"],
          oracle=VALIDATED_SQL + "\nselect * from validated")
def _validated(fx):
    return K.validate_proposals(fx.view("v_proposals"), fx.view("v_taxonomy"))


@register("keywords_json", views=["v_responses"], oracle="""
select company_number, case
  when json_type(j, '$.specialisms') is null then '[]'
  when json_type(j, '$.specialisms') = 'ARRAY' then '[' || array_to_string(list_transform(
       json_extract_string(j, '$.specialisms[*]'), lambda x: '"' || x || '"'), ', ') || ']'
  when json_type(j, '$.specialisms') = 'NULL' then 'None'
  else json_extract_string(j, '$.specialisms') end as keywords_json
from (select company_number, cast(u as json) as j from (select company_number,
  regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', '') as u
  from v_responses) a where json_valid(u)) b
where json_type(j) = 'OBJECT'""".replace("\\\\", "\\"))
def _keywords(fx):
    return K.response_keywords(fx.view("v_responses"))


# What the original prints for each kind of value, written out.
@register("keywords_json_values", views=["v_keyword_values"], oracle=r"""
select doc_id as company_number, case doc_id % 7 when 0 then '[1, 2.5, null, true]'
  when 1 then '["caf\u00e9", "a, b: c", ["x", false], "say \"hi\""]'
  when 2 then 'True' when 3 then 'None' when 4 then coalesce(source, 'none')
  when 5 then '{''a'': None, ''b'': [''it'', 3]}'
  else '["' || coalesce(source, 'none') || '", ' || doc_id || ']' end as keywords_json
from documents""")
def _keyword_values(fx):
    return K.response_keywords(fx.view("v_keyword_values"))


@register("carry_over", views=["v_proposals", "v_taxonomy", "v_research"], oracle=VALIDATED_SQL + """
select lpad(cast(v.company_number as varchar), 8, '0') as company_number, v.sector, v.sub_sector,
  v.confidence, r.domain, cast(null as varchar) as domain_confidence,
  cast(null as varchar) as domain_method, cast(null as int) as website_raw_text_length,
  r.services_description, cast(null as varchar[]) as specialisms, r.sampled_for_discovery
from validated v join v_research r on r.company_number = lpad(cast(v.company_number as varchar), 8, '0')""")
def _carry(fx):
    p = K.validate_proposals(fx.view("v_proposals"), fx.view("v_taxonomy")) \
        .withColumn("company_number", F.lpad(F.col("company_number").cast("string"), 8, "0"))
    return K.carry_over(p, fx.view("v_research"))


@register("chunk_stats", views=["v_companies_raw", "v_research"], oracle=f"""{COMPANIES_CTES},
p as (select company_number, input_seq, row_number() over (order by input_seq, company_number) as seq
  from companies where company_number not in (
  select company_number from v_research where sector is not null or error_log is not null))
select cast(floor((seq - 1) / 1000) as bigint) as chunk_no, count(*) as n,
  min(seq) as first_seq, max(seq) as last_seq from p group by 1""")
def _chunks(fx):
    return K.chunk_stats(K.pending(companies(fx), fx.view("v_research")))


# ---- refresh ----

LATEST_SQL = "(select max(taxonomy_version_id) from v_research)"


def latest(fx):
    return fx.view("v_research").agg(F.max("taxonomy_version_id").alias("version_id"))


@register("gap_rows", views=["v_research"], oracle=f"""
select company_number, company_name, services_description from v_research
where sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL}""")
def _gap(fx):
    return R.gap_rows(fx.view("v_research"), latest(fx))


CONTEXT_ROWS_SQL = f"""select company_number, sector from v_research
where sector is not null and sector <> 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL}
order by md5('42:' || company_number), company_number limit 200"""


@register("context_sample", views=["v_research"], oracle=CONTEXT_ROWS_SQL)
def _context(fx):
    return R.context_sample(fx.view("v_research"), latest(fx)).select("company_number", "sector")


@register("refresh_size", views=["v_research"], oracle=f"""
select g.n as n_gap, c.n as n_context, g.n + c.n as n_total from
  (select count(*) as n from v_research where sector = 'UNCLASSIFIED'
     and taxonomy_version_id = {LATEST_SQL}) g,
  (select count(*) as n from ({CONTEXT_ROWS_SQL}) z) c""")
def _size(fx):
    st = fx.view("v_research")
    return R.refresh_size(R.gap_rows(st, latest(fx)), R.context_sample(st, latest(fx)))


DECISIONS = [("unclassified_threshold", False, False), ("manual", False, False),
             ("unclassified_threshold", True, False), ("unclassified_threshold", True, True)]


def _facts(fx):
    st = fx.view("v_research")
    lv = latest(fx)
    cur, new = fx.view("v_taxonomy"), fx.view("v_taxonomy_new")
    facts = lv.select(F.col("version_id").alias("latest_version"))
    for part in [cur.agg((F.count(F.lit(1)) > 0).alias("has_taxonomy")),
                 R.gap_rows(st, lv).agg(F.count(F.lit(1)).alias("n_gap")),
                 new.agg(F.countDistinct("sector_pos").alias("n_new_sectors")),
                 T.validate(new, expected=5).agg(F.count(F.lit(1)).alias("n_errors")),
                 T.diff(cur, new).filter(F.col("change") == "lost")
                   .agg(F.count(F.lit(1)).alias("n_lost"))]:
        facts = attach_one_row(facts, part)
    return facts


_ERRS_NEW = "with " + ERRORS_SQL.replace("{expected}", "5").replace(
    "v_taxonomy_bad", "v_taxonomy_new").strip()[2:]

_DECISION_ROWS = " union all ".join(
    f"select '{t}' as trigger, {str(f).lower()} as force, {str(d).lower()} as dry_run"
    for t, f, d in DECISIONS)


@register("refresh_decision", views=["v_research", "v_taxonomy", "v_taxonomy_new"], oracle=f"""
, facts as (select {LATEST_SQL} as latest_version,
  (select count(*) > 0 from v_taxonomy) as has_taxonomy,
  (select count(*) from v_research where sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL}) as n_gap,
  (select count(distinct sector_pos) from v_taxonomy_new) as n_new_sectors,
  (select count(*) from ({_ERRS_NEW}) e) as n_errors,
  (select count(*) from (select distinct sector from v_taxonomy where sector is not null
     except select distinct sector from v_taxonomy_new where sector is not null) l) as n_lost),
p as ({_DECISION_ROWS}),
r as (select p.*, facts.*, case
  when latest_version is null then 'no current taxonomy in DB'
  when not has_taxonomy then 'taxonomy file not found'
  when trigger = 'manual' and n_gap = 0 then 'no unclassified companies'
  when n_new_sectors = 0 then 'refresh returned nothing'
  when n_errors > 0 and not force then 'validation failed (use --force to accept anyway)'
  when n_lost > 0 and not force then 'sector rename blocked'
  when dry_run then 'dry-run' end as reason from p, facts)
select trigger, force, dry_run, reason is null as accepted, reason,
  case when reason is null then cast(latest_version + 1 as int) end as new_version_id from r""")
def _decision(fx):
    facts = _facts(fx)
    out = None
    for t, f, d in DECISIONS:
        one = R.refresh_decision(facts, force=f, dry_run=d, trigger=t)
        out = one if out is None else out.unionByName(one)
    return out


@register("cleared_cohort", views=["v_research"], oracle=f"""
, c as (select company_number,
  case when sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL} then null else sector end as sector,
  case when sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL} then null else taxonomy_version_id end as taxonomy_version_id,
  services_description from v_research)
select company_number from c
where sector is null and taxonomy_version_id is null and services_description is not null""")
def _cohort(fx):
    return R.cleared_cohort(fx.view("v_research"), latest(fx)).select("company_number")


@register("reclass_outcome", views=["v_proposals", "v_taxonomy"], oracle=VALIDATED_SQL + """
select case when coalesce(sector, 'UNCLASSIFIED') <> 'UNCLASSIFIED' then 'placed' else 'unclassified' end as outcome,
  count(*) as n from validated group by 1""")
def _outcome(fx):
    return R.outcome_counts(K.validate_proposals(fx.view("v_proposals"), fx.view("v_taxonomy")))


# ---- sampling ----

def _sample_sql(n, postcode="postcode"):
    area = f"coalesce({postcode_area_sql(postcode)}, '_NONE_')"
    return f"""{COMPANIES_CTES},
a as (select company_number, {area} as area, md5('42:' || company_number) as h from companies),
c as (select area, count(*) as cnt from a group by area), t as (select sum(cnt) as total from c),
q as (select area, least(round_even(cast({n} as double) * (cnt / total), 0), cnt) as quota from c, t),
r as (select a.*, row_number() over (partition by area order by h, company_number) as rn from a),
j as (select r.*, rn <= quota as in_q from r join q on q.area = r.area)
select company_number, area from j order by in_q desc, h, company_number limit {n}"""


@register("stratified_sample", views=["v_companies_raw"], oracle=_sample_sql(250))
def _stratified(fx):
    return SM.stratified_sample(companies(fx), 250).select("company_number", "area")


@register("simple_sample", views=["v_companies_raw"], oracle=_sample_sql(250, "cast(null as varchar)"))
def _simple(fx):
    c = companies(fx).withColumn("postcode", F.lit(None).cast("string"))
    return SM.stratified_sample(c, 250).select("company_number", "area")


@register("sticky_sample", views=["v_companies_raw", "v_research"], oracle=f"""{COMPANIES_CTES}
select company_number from companies where company_number in (
  select company_number from v_research where sampled_for_discovery = 1)""")
def _sticky(fx):
    return SM.sticky_sample(companies(fx), fx.view("v_research"), 250).select("company_number")


RERUN_SQL = """select r.company_number, r.company_name, n.domain, n.services_description,
  case when right(r.company_number, 1) = '0' then 'services_extraction: None returned' end as error_log,
  case when n.services_description <> 'INSUFFICIENT_DATA' and right(r.company_number, 1) <> '3' then n.sector end as sector
from v_research r left join v_research n
  on n.company_number = lpad(cast(cast(r.company_number as bigint) + 1 as {text}), 8, '0')
where r.error_log is not null and right(r.company_number, 1) <> '7'"""


@register("retry_outcome", views=["v_research"], oracle=f"""
, again as ({RERUN_SQL.format(text="varchar")}),
j as (select r.company_number, r.company_name, r.error_log as was_error, r.domain as was_domain, r.sector as was_sector,
    r.services_description as was_text, a.company_number as rerun, a.error_log, a.domain, a.sector, a.services_description
  from v_research r left join again a on a.company_number = r.company_number where r.error_log is not null),
n as (select company_number, company_name, was_error, was_sector, was_domain,
    case when rerun is null then null else error_log end as now_error,
    case when rerun is null then was_domain else domain end as now_domain,
    case when rerun is null then was_sector else sector end as now_sector,
    coalesce(case when rerun is null then was_text else services_description end, '') as text from j)
select company_number, company_name, was_error, now_error, was_domain is distinct from now_domain as domain_changed,
  text not in ('', 'INSUFFICIENT_DATA') as usable, was_sector, now_sector,
  case when now_error is not null then 'errored' when now_sector = 'UNCLASSIFIED' then 'unclassified'
    when now_sector is not null then 'placed' when text not in ('', 'INSUFFICIENT_DATA') then 'described'
    when text <> '' then 'insufficient' else 'empty' end as outcome
from n""")
def _retry(fx):
    """RTY3 over a patch log: the state, its errors cleared, the rows that a rerun gave (each errored company gets
    what its neighbour holds; some get nothing), and the two as-of reads compared."""
    store = modes.ResearchStore(fx.spark, state_root(fx.spark, "checks", f"retry-{uuid.uuid4().hex}"))
    state = fx.view("v_research")
    store.append(state, stamp=False)
    bad = RT.errored(state)
    first = store.append(S.clear_error(state, bad).join(bad, "company_number", "left_semi"), stamp=False)
    last = store.append(fx.sql(["v_research"], RERUN_SQL.format(text="string")), stamp=False)
    return modes.retry_report(store, first, last + 1)


COHORT_SQL = f"""select company_number, services_description from (
  select company_number,
    case when sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL} then null else sector end as sector,
    case when sector = 'UNCLASSIFIED' and taxonomy_version_id = {LATEST_SQL} then null else taxonomy_version_id end as tv,
    services_description from v_research) c
where sector is null and tv is null and services_description is not null"""

_LEX_NEW = LEXICAL_TEMPLATE.replace("{tax}", "v_taxonomy_new").replace("{comp}", "cohort")
_LEX_BODY = _LEX_NEW.strip()[1:].strip()  # drop the leading comma of the CTE list
_LEX_CTES, _LEX_SELECT = _LEX_BODY.split("\nselect company_number, sector, sub_sector,", 1)


@register("reclassify_cohort", views=["v_research", "v_taxonomy_new"], oracle=f"""
, cohort as ({COHORT_SQL}),
{_LEX_CTES},
lex as (select company_number, sector, sub_sector,{_LEX_SELECT}),
names as (select sector, min(sector_pos) as p from v_taxonomy_new where sector is not null group by sector),
pairs as (select distinct t.sector, t.sub_sector from v_taxonomy_new t join names n
  on n.sector = t.sector and n.p = t.sector_pos where t.sub_pos is not null)
select l.company_number, l.rationale, l.keywords, l.score, l.shared,
  case when l.sector = 'UNCLASSIFIED' then l.sector
       when n.sector is null or pa.sector is null then 'UNCLASSIFIED' else l.sector end as sector,
  case when l.sector = 'UNCLASSIFIED' or n.sector is null or pa.sector is null then null
       else l.sub_sector end as sub_sector,
  case when l.sector = 'UNCLASSIFIED' then l.confidence
       when n.sector is null or pa.sector is null then 'LOW' else l.confidence end as confidence
from lex l left join names n on n.sector = l.sector
left join pairs pa on pa.sector = l.sector and pa.sub_sector = l.sub_sector""")
def _reclassify(fx):
    """CLS10: the cleared cohort (RFR5) classified against the newest taxonomy."""
    cohort = R.cleared_cohort(fx.view("v_research"), latest(fx))
    return K.reclassify(cohort, fx.view("v_taxonomy_new"))
