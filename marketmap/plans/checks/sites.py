"""Checks for DOM1-9, PAG1-4 and SVC1-8."""

from pyspark.sql import functions as F

from marketmap.constants import TOKEN_STOP_WORDS
from marketmap.operators import domains as D
from marketmap.operators import pages as P
from marketmap.operators import services as V
from marketmap.plans.checks.sources import COMPANIES_CTES, companies, slug_sql, strip_sql
from marketmap.plans.checks.text import (
    bare_sql, clean_name_sql, html_text_sql, host_sql, is_directory_sql, postcode_sector_sql,
    tokens_sql, url_host_sql)
from marketmap.plans.registry import register


def hits(fx, comp=None):
    """Search hits keyed by company (input position -> company number)."""
    c = (comp if comp is not None else companies(fx)) \
        .select("company_number", F.col("input_seq").alias("company_seq"))
    return fx.view("v_search_hits").join(c, "company_seq") \
        .select("company_number", "query_no", "rank", "link")


HITS_SQL = """select c.company_number, h.query_no, h.rank, h.link
from v_search_hits h join companies c on c.input_seq = h.company_seq"""

CAND_SQL = f"""select company_number, t.pref, {slug_sql('company_name')} || '.' || t.tld as candidate
from companies, (values (0, 'co.uk'), (1, 'com'), (2, 'uk'), (3, 'org.uk')) t(pref, tld)
where length({slug_sql('company_name')}) >= 3"""

GUESS_SQL = """select company_number, arg_min(candidate, pref) as domain, 'HIGH' as domain_confidence,
  'guess' as domain_method
from cand join (select distinct host from v_host_probe where status_code >= 200 and status_code < 400) p
  on p.host = cand.candidate group by company_number"""

QUERIES_SQL = f"""select company_number, query_no, query from (
  select company_number, 1 as query_no, '"' || {clean_name_sql('company_name')} || '" ' || {postcode_sector_sql('postcode')} as query,
    {postcode_sector_sql('postcode')} as pc, {tokens_sql('company_name')} as tk from companies
  union all
  select company_number, 2, '"' || {clean_name_sql('company_name')} || '"', 'x', {tokens_sql('company_name')} from companies
  union all
  select company_number, 3, {clean_name_sql('company_name')} || ' ' || {postcode_sector_sql('postcode')},
    {postcode_sector_sql('postcode')}, {tokens_sql('company_name')} from companies) z
where pc is not null and len(tk) > 0"""

SCORED_SQL = f"""select h.company_number, h.query_no, h.rank, h.link, {bare_sql('h.link')} as bare,
  cast(case when {bare_sql('h.link')} = '' then 0
       else len(list_filter({tokens_sql('c.company_name')}, lambda t: strpos({bare_sql('h.link')}, t) > 0)) end as int) as score
from hx h join companies c on c.company_number = h.company_number"""

SEARCH_PREFIX = f"""
, hits as ({HITS_SQL}), q as ({QUERIES_SQL}),
hx as (select hits.* from hits join q on q.company_number = hits.company_number and q.query_no = hits.query_no
  where link is not null and link <> '' and not {is_directory_sql(host_sql('link'))}),
sc as ({SCORED_SQL}),
acc as (select company_number, query_no, rank, {url_host_sql('link')} as host,
  case when score >= 6 then 'HIGH' when score >= 3 then 'MEDIUM' end as band from sc)"""

SEARCH_SELECT = """select company_number, arg_min(host, (query_no, rank)) as domain,
  arg_min(band, (query_no, rank)) as domain_confidence, 'serper' as domain_method
from acc where band is not null and host <> '' group by company_number"""

SEARCH_SQL = SEARCH_PREFIX + "\n" + SEARCH_SELECT


@register("domain_candidates", views=["v_companies_raw"],
          oracle=f"{COMPANIES_CTES}\n{CAND_SQL}")
def _cand(fx):
    return D.guess_candidates(companies(fx))


@register("domain_guess", views=["v_companies_raw", "v_host_probe"],
          oracle=f"{COMPANIES_CTES}, cand as ({CAND_SQL})\n{GUESS_SQL}")
def _guess(fx):
    return D.guess_domain(D.guess_candidates(companies(fx)), fx.view("v_host_probe"))


@register("search_queries", views=["v_companies_raw"], oracle=f"{COMPANIES_CTES}\n{QUERIES_SQL}")
def _queries(fx):
    return D.search_queries(companies(fx))


DEDUP_HITS_SQL = """select company_number, query_no, rank, link from (
  select *, row_number() over (partition by company_number, link order by query_no, rank) rn
  from hits where link is not null and link <> '') z where rn = 1"""


@register("search_hits_dedup", views=["v_companies_raw", "v_search_hits"],
          oracle=f"{COMPANIES_CTES}, hits as ({HITS_SQL})\n{DEDUP_HITS_SQL}")
def _dedup_hits(fx):
    return D.dedupe_hits(hits(fx))


@register("search_hits_filtered", views=["v_companies_raw", "v_search_hits"],
          oracle=f"""{COMPANIES_CTES}, hits as ({HITS_SQL}), d as ({DEDUP_HITS_SQL})
select * from d where not {is_directory_sql(host_sql('link'))}""")
def _filtered(fx):
    return D.drop_directories(D.dedupe_hits(hits(fx)))


@register("domain_scores", views=["v_companies_raw", "v_search_hits"],
          oracle=f"""{COMPANIES_CTES}, hits as ({HITS_SQL}), d as ({DEDUP_HITS_SQL}),
hx as (select * from d where not {is_directory_sql(host_sql('link'))}), sc as ({SCORED_SQL})
select company_number, query_no, rank, bare, score from sc""")
def _scores(fx):
    h = D.drop_directories(D.dedupe_hits(hits(fx)))
    return D.score_hits(h, companies(fx)).select("company_number", "query_no", "rank", "bare",
                                                 "score")


@register("domain_bands", views=["v_companies_raw", "v_search_hits"],
          oracle=f"""{COMPANIES_CTES}, hits as ({HITS_SQL}), d as ({DEDUP_HITS_SQL}),
hx as (select * from d where not {is_directory_sql(host_sql('link'))}), sc as ({SCORED_SQL})
select company_number, query_no, rank, score,
  case when score >= 6 then 'HIGH' when score >= 3 then 'MEDIUM' end as band from sc""")
def _bands(fx):
    h = D.drop_directories(D.dedupe_hits(hits(fx)))
    return D.score_hits(h, companies(fx)).select("company_number", "query_no", "rank", "score",
                                                 "band")


@register("domain_search", views=["v_companies_raw", "v_search_hits"],
          oracle=f"{COMPANIES_CTES}{SEARCH_SQL}")
def _search(fx):
    c = companies(fx)
    return D.search_domain(c, hits(fx, c))


@register("domain_resolved", views=["v_companies_raw", "v_host_probe", "v_search_hits"],
          oracle=f"""{COMPANIES_CTES}, cand as ({CAND_SQL}), g as ({GUESS_SQL}){SEARCH_PREFIX},
s as ({SEARCH_SELECT})
select c.company_number, coalesce(g.domain, s.domain) as domain,
  case when g.company_number is not null then g.domain_confidence else s.domain_confidence end as domain_confidence,
  case when g.company_number is not null then g.domain_method else s.domain_method end as domain_method
from companies c left join g on g.company_number = c.company_number
left join s on s.company_number = c.company_number""")
def _resolved(fx):
    c = companies(fx)
    return D.resolve_domains(c, fx.view("v_host_probe"), hits(fx, c))


# ---- pages ----

PLAN_SQL = """select host, p.path_ord, p.path, 'https://' || regexp_replace(regexp_replace(host, '^/+', ''), '/+$', '') || p.path as url
from (select distinct host from v_site_pages where host is not null and host <> '') h,
  (values (1, '/'), (2, '/about'), (3, '/about-us'), (4, '/services'), (5, '/what-we-do'),
          (6, '/products'), (7, '/our-story')) p(path_ord, path)"""

FETCHED_SQL = """select p.host, p.path_ord, s.page_id, s.status_code, s.html
from plan p join v_site_pages s on s.host = p.host and s.path_ord = p.path_ord
where s.status_code = 200 and s.html is not null and s.html <> ''"""

GOOD_SQL = f"""select host, path_ord, text from (
  select host, path_ord, text, row_number() over (partition by host order by path_ord) rn
  from (select host, path_ord, {html_text_sql('html')} as text from fetched) a
  where length(text) >= 500) b where rn <= 3"""


def _site_domains(fx):
    return fx.view("v_site_pages").select(F.col("host").alias("domain")).distinct()


@register("page_plan", views=["v_site_pages"], oracle=PLAN_SQL)
def _plan(fx):
    return P.page_plan(_site_domains(fx))


@register("pages_fetched", views=["v_site_pages"],
          oracle=f", plan as ({PLAN_SQL})\nselect host, path_ord, page_id from ({FETCHED_SQL}) z")
def _fetched(fx):
    return P.fetched_pages(P.page_plan(_site_domains(fx)), fx.view("v_site_pages")) \
        .select("host", "path_ord", "page_id")


@register("good_pages", views=["v_site_pages"], oracle=f""", plan as ({PLAN_SQL}),
fetched as ({FETCHED_SQL})
select host, path_ord, cast(length(text) as int) as text_length from ({GOOD_SQL}) z""")
def _good(fx):
    g = P.good_pages(P.fetched_pages(P.page_plan(_site_domains(fx)), fx.view("v_site_pages")))
    return g.select("host", "path_ord", F.length("text").alias("text_length"))


SITE_CTES = f""", plan as ({PLAN_SQL}), fetched as ({FETCHED_SQL}), good as ({GOOD_SQL})"""
SITE_SELECT = """select host, cast(length(string_agg(text, chr(10) || chr(10) order by path_ord)) as int) as raw_length,
  substr(string_agg(text, chr(10) || chr(10) order by path_ord), 1, 3000) as text
from good group by host"""
SITE_SQL = f"{SITE_CTES}\n{SITE_SELECT}"


@register("site_text", views=["v_site_pages"], oracle=SITE_SQL)
def _site(fx):
    return P.scrape(_site_domains(fx), fx.view("v_site_pages"))


# ---- services ----

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNFENCE_SQL = ("regexp_replace(regexp_replace(" + strip_sql("raw") + ", '^```(?:json)?" + WS +
               "*', ''), '" + WS + "*```$', '')")
UNFENCED_SQL = strip_sql(UNFENCE_SQL)


@register("response_unfenced", views=["v_responses"],
          oracle=f"select company_number, {UNFENCED_SQL} as unfenced from v_responses")
def _unfenced(fx):
    from marketmap.functions.text import strip_fences
    return fx.view("v_responses").select("company_number",
                                         strip_fences("raw").alias("unfenced"))


KIND_SQL = """case json_type(j) when 'OBJECT' then 'object' when 'ARRAY' then 'array'
  when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
  else 'number' end"""


@register("response_valid", views=["v_responses"], oracle=f"""
select company_number, j is not null as is_valid, case when j is null then null else {KIND_SQL} end as kind
from (select company_number, case when json_valid({UNFENCED_SQL}) then cast({UNFENCED_SQL} as json) end as j
      from v_responses) z""")
def _valid(fx):
    v = V.parse_response("raw")
    return fx.view("v_responses").select("company_number", v.isNotNull().alias("is_valid"),
                                         V.json_kind(v).alias("kind"))


SERVICES_SQL = f"""select company_number, raw,
  case when is_obj and svc_kind = 'VARCHAR' then json_extract_string(j, '$.services')
       when not coalesce(is_obj, false) and strpos(upper(raw), 'INSUFFICIENT_DATA') > 0 then 'INSUFFICIENT_DATA' end as services,
  case when is_obj and svc_kind = 'VARCHAR' then
         case when json_type(j, '$.specialisms') = 'ARRAY' then json_extract_string(j, '$.specialisms[*]')
              else cast([] as varchar[]) end
       when not coalesce(is_obj, false) and strpos(upper(raw), 'INSUFFICIENT_DATA') > 0 then cast([] as varchar[]) end as specialisms,
  case when is_obj and svc_kind = 'VARCHAR' then 'ok'
       when not coalesce(is_obj, false) and strpos(upper(raw), 'INSUFFICIENT_DATA') > 0 then 'sentinel'
       else 'rejected' end as status
from (select company_number, raw, j, json_type(j) = 'OBJECT' as is_obj, json_type(j, '$.services') as svc_kind
      from (select company_number, raw, case when json_valid({UNFENCED_SQL}) then cast({UNFENCED_SQL} as json) end as j
            from v_responses) a) b"""


@register("services_extracted", views=["v_responses"], oracle=SERVICES_SQL)
def _services(fx):
    return V.extract_services(fx.view("v_responses"))


@register("services_sentinel", views=["v_responses"],
          oracle=f"select company_number, services, specialisms from ({SERVICES_SQL}) z where status = 'sentinel'")
def _sentinel(fx):
    return V.extract_services(fx.view("v_responses")).filter(F.col("status") == "sentinel") \
        .select("company_number", "services", "specialisms")


TERM_RE, STOP_SQL = "'[a-z][a-z0-9]{3,}'", ", ".join(f"'{w}'" for w in TOKEN_STOP_WORDS)
INFER_SQL = rf"""{SITE_CTES}, site as ({SITE_SELECT}),
words as (select host, unnest(regexp_extract_all(lower(text), {TERM_RE})) as w from site),
counted as (select host, w, count(*) as n from words where w not in ({STOP_SQL}) group by host, w),
ranked as (select host, w, row_number() over (partition by host order by n desc, w) as r from counted),
terms as (select host, list(w order by r) as specialisms from ranked where r <= 5 group by host),
cut as (select host, string_split(regexp_replace(trim(text, e' \t\n\r\f'), '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) as s
  from site),
sentences as (select host, unnest(s) as s, generate_subscripts(s, 1) as i from cut),
found as (select distinct host, i, w from (select host, i, unnest(regexp_extract_all(lower(s), {TERM_RE})) as w from sentences) z),
hits as (select f.host, f.i, count(*) as score from found f join ranked r on r.host = f.host and r.w = f.w and r.r <= 5 group by f.host, f.i),
best as (select s.host, s.i, s.s, row_number() over (partition by s.host order by coalesce(h.score, 0) desc, s.i) as r
  from sentences s left join hits h on h.host = s.host and h.i = s.i)
select b.host, string_agg(b.s, ' ' order by b.i) as services,
  any_value(coalesce(t.specialisms, cast([] as varchar[]))) as specialisms, 'ok' as status
from best b left join terms t on t.host = b.host where b.r <= 2 group by b.host"""


@register("services_infer", views=["v_site_pages"], oracle=INFER_SQL)
def _infer(fx):
    sites = P.scrape(_site_domains(fx), fx.view("v_site_pages"))
    return V.extract_services(V.infer_services(sites)).select("host", "services", "specialisms", "status")


@register("eligible_services", views=["v_research"], oracle="""
select company_number, company_name, services_description from v_research
where sampled_for_discovery = 1 and services_description is not null
  and services_description <> 'INSUFFICIENT_DATA'""")
def _eligible(fx):
    return V.eligible_services(fx.view("v_research"))


@register("stage_due", views=["v_research"], oracle="""
select company_number, coalesce(domain, '') = '' as need_domain,
  coalesce(domain, '') <> '' and coalesce(services_description, '') = '' as need_scrape,
  coalesce(domain, '') <> '' and coalesce(services_description, '') = '' as need_describe
from v_research""")
def _stage_due(fx):
    return V.stage_due(fx.view("v_research"))


@register("error_log_rows", views=["v_research"], oracle="""
select company_number, nullif(concat_ws(' | ',
  case when domain is null then 'domain_find: no domain' end,
  error_log,
  case when domain is not null and services_description is null then 'services_extraction: None returned' end), '') as error_log
from v_research""")
def _errors(fx):
    r = fx.view("v_research")
    return r.select("company_number", V.assemble_errors(
        F.when(F.col("domain").isNull(), F.lit("domain_find: no domain")),
        F.col("error_log"),
        F.when(F.col("domain").isNotNull() & F.col("services_description").isNull(),
               F.lit("services_extraction: None returned"))).alias("error_log"))
