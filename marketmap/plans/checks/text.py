"""Checks for TXT1-9 (text rules as column expressions)."""

from pyspark.sql import functions as F

from marketmap.constants import DIRECTORY_DOMAINS, NONE_AREA
from marketmap.functions import text as X
from marketmap.plans.checks.sources import COMPANIES_CTES, WS, companies, slug_sql, strip_sql
from marketmap.plans.registry import register

STRIP_WORDS_SQL = r"'\b(?:HOLDINGS|LIMITED|GROUP|LTD|PLC|LLP)\b'"
STOP_SQL = "['ltd', 'limited', 'plc', 'llp', 'group', 'the', 'and', 'services', 'company', 'holdings']"


def clean_name_sql(x):
    return strip_sql(f"regexp_replace(regexp_replace(upper({x}), {STRIP_WORDS_SQL}, ' ', 'g'), '{WS}+', ' ', 'g')")


def tokens_sql(x):
    return (f"list_filter(regexp_extract_all(lower({x}), '[a-zA-Z0-9]+'), "
            f"lambda t: length(t) >= 3 and not list_contains({STOP_SQL}, t))")


PC_RE = r"'^([A-Z]{1,2}\d{1,2}[A-Z]?)\s*(\d)'"


def postcode_sector_sql(x):
    n = f"upper({strip_sql(x)})"
    return (f"case when {x} is null or regexp_extract({n}, {PC_RE}, 1) = '' then null "
            f"else regexp_extract({n}, {PC_RE}, 1) || ' ' || regexp_extract({n}, {PC_RE}, 2) end")


def postcode_area_sql(x):
    return f"nullif(regexp_extract(upper({strip_sql(x)}), '^([A-Z]{{1,2}})', 1), '')"


def host_sql(x):
    s = strip_sql(x)
    s = f"(case when strpos({s}, '://') > 0 then {s} else 'http://' || {s} end)"
    return (f"regexp_replace(lower(regexp_extract({s}, "
            r"'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\.', '')")


def url_host_sql(x):
    return (f"regexp_replace(lower(regexp_extract({x}, "
            r"'^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\.', '')")


def bare_sql(x):
    return f"split_part({host_sql(x)}, '.', 1)"


DIRECTORY_SQL = "(?:" + "|".join(d.replace(".", r"\.") for d in DIRECTORY_DOMAINS) + ")"


def is_directory_sql(h):
    return f"regexp_matches({h}, '{DIRECTORY_SQL}')"


def html_text_sql(x):
    e = x
    for tag in ["script", "style"]:
        e = f"regexp_replace({e}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<!--.*?(?:-->|\\z)', ' ', 'g')"
    for tag in ["nav", "footer", "header", "noscript"]:
        e = f"regexp_replace({e}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    e = f"regexp_replace({e}, '<(?:/?[A-Za-z][^>]*|[!?][^>]*)>', ' ', 'g')"
    for pat, rep in [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#0*39;", "''"),
                     ("&#[xX]0*27;", "''"), ("&apos;", "''"), ("&nbsp;?", " "),
                     ("&copy;?", "©"), ("&reg;?", "®"), ("&middot;?", "·"), ("&amp;?", "&")]:
        e = f"regexp_replace({e}, '{pat}', '{rep}', 'g')"
    return strip_sql(f"regexp_replace({e}, '{WS}+', ' ', 'g')")


@register("company_slug", views=["v_companies_raw"], oracle=f"""
{COMPANIES_CTES}
select company_number, {slug_sql('company_name')} as slug from companies""")
def _slug(fx):
    return companies(fx).select("company_number", X.slug("company_name").alias("slug"))


@register("company_clean_name", views=["v_companies_raw"], oracle=f"""
{COMPANIES_CTES}
select company_number, {clean_name_sql('company_name')} as clean_name from companies""")
def _clean_name(fx):
    return companies(fx).select("company_number", X.clean_name("company_name").alias("clean_name"))


@register("company_tokens", views=["v_companies_raw"], oracle=f"""
{COMPANIES_CTES}
select company_number, {tokens_sql('company_name')} as tokens from companies""")
def _tokens(fx):
    return companies(fx).select("company_number", X.name_tokens("company_name").alias("tokens"))


@register("postcode_sector", views=["v_companies_raw"], oracle=f"""
{COMPANIES_CTES}
select company_number, postcode, {postcode_sector_sql('postcode')} as postcode_sector
from companies""")
def _pc_sector(fx):
    return companies(fx).select("company_number", "postcode",
                                X.postcode_sector("postcode").alias("postcode_sector"))


@register("postcode_area_counts", views=["v_companies_raw"], oracle=f"""
{COMPANIES_CTES}
select coalesce({postcode_area_sql('postcode')}, '{NONE_AREA}') as area, count(*) as n
from companies group by 1""")
def _area_counts(fx):
    return companies(fx).groupBy(
        F.coalesce(X.postcode_area("postcode"), F.lit(NONE_AREA)).alias("area")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("page_hosts", views=["v_search_hits"], oracle=f"""
select company_seq, query_no, rank, {host_sql('link')} as host from v_search_hits""")
def _hosts(fx):
    return fx.view("v_search_hits").select("company_seq", "query_no", "rank",
                                           X.host("link").alias("host"))


@register("bare_domains", views=["v_search_hits"], oracle=f"""
select company_seq, query_no, rank, {bare_sql('link')} as bare from v_search_hits""")
def _bare(fx):
    return fx.view("v_search_hits").select("company_seq", "query_no", "rank",
                                           X.bare_label("link").alias("bare"))


@register("directory_hosts", views=["v_search_hits"], oracle=f"""
select host, {is_directory_sql('host')} as is_directory
from (select distinct {host_sql('link')} as host from v_search_hits) z""")
def _directory(fx):
    h = fx.view("v_search_hits").select(X.host("link").alias("host")).distinct()
    return h.select("host", X.is_directory_host("host").alias("is_directory"))


@register("page_text", views=["v_site_pages"], oracle=f"""
select page_id, {html_text_sql('html')} as text from v_site_pages""")
def _page_text(fx):
    return fx.view("v_site_pages").select("page_id", X.html_text("html").alias("text"))
