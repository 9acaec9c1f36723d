"""Input bindings over the driver tables.

Each ``v_*`` view is one SQL text that runs unchanged on Spark and on DuckDB,
so a Spark job and its oracle read identical inputs. In Spark the views are
temp views over the parquet tables of one scale-factor folder; in the oracle
they become CTEs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from marketmap.session import ensure_checkpoint_dir, path_exists

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

VIEWS: dict[str, str] = {
    "v_companies_raw": """select p_partkey as input_seq, case when p_partkey % 5 = 0 then '' else lpad(cast(p_partkey - case when p_partkey % 20 = 7 then 1 else 0 end as string), 8, '0') end as company_number, case when p_partkey % 101 = 0 then '  ' when p_partkey % 97 = 0 then 'LTD' else concat(' ', upper(p_name), ' ', p_type, case p_partkey % 3 when 0 then '' when 1 then ' PARTS' else ' PARTS WORKS TRADING' end, case p_partkey % 6 when 0 then ' LIMITED' when 1 then ' GROUP PLC' when 2 then '(MARGATE)LTD' when 3 then ' HOLDINGS LLP' when 4 then ' & SON' else '' end) end as company_name, case when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'RH12' else concat(case p_partkey % 6 when 0 then 'rh' when 1 then 'S' when 2 then 'CT' when 3 then 'LS' when 4 then 'B' else 'W' end, cast(1 + p_partkey % 20 as string), case when p_partkey % 7 = 0 then '' else ' ' end, cast(p_partkey % 10 as string), 'AB') end as postcode from part""",
    "v_site_pages": """select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, row_number() over (partition by lower(regexp_extract(url, '://([^/?#:]*)', 1)) order by page_id) as path_ord, case when page_id % 9 = 0 then 404 else 200 end as status_code, html from pages""",
    "v_responses": """select doc_id as company_number, case doc_id % 7 when 0 then concat('```json', chr(10), '{"services": "', md5(text), '", "specialisms": ["', lang, '", "', source, '"]}', chr(10), '```') when 1 then concat('{"services": "', md5(text), '", "specialisms": "none"}') when 2 then '{"services": 5, "specialisms": []}' when 3 then 'sorry: insufficient_data' when 4 then 'not json' when 5 then '"INSUFFICIENT_DATA"' else concat('{"services": "', md5(text), '"}') end as raw from documents""",
    "v_keyword_values": """select doc_id as company_number, case doc_id % 7 when 0 then '{"specialisms": [1, 2.5, null, true]}' when 1 then '{"specialisms": ["café", "a, b: c", ["x", false], "say \\\\"hi\\\\""]}' when 2 then '{"specialisms": true}' when 3 then '{"specialisms": null}' when 4 then concat('{"specialisms": "', coalesce(source, 'none'), '"}') when 5 then '{"specialisms": {"a": null, "b": ["it", 3]}}' else concat('{"specialisms": ["', coalesce(source, 'none'), '", ', cast(doc_id as string), ']}') end as raw from documents""",
    "v_shape_elements": """select p_partkey, case p_partkey % 6 when 0 then '5' when 1 then '{"name": 5}' when 2 then concat('{"name": "Field ', cast(p_partkey as string), '", "sub_sectors": "none"}') when 3 then concat('{"name": "Field ', cast(p_partkey as string), '", "sub_sectors": ["s", {"name": "A"}, {}, {"name": "A"}]}') when 4 then concat('{"name": "Other ', cast(p_partkey as string), '"}') else concat('{"name": "Field ', cast(p_partkey as string), '", "sub_sectors": null}') end as element from part""",
    "v_taxonomy": """select cast(r_regionkey as int) as sector_pos, r_name as sector, cast(row_number() over (partition by r_regionkey order by n_nationkey) - 1 as int) as sub_pos, n_name as sub_sector from region join nation on n_regionkey = r_regionkey""",
    "v_taxonomy_bad": """select cast(b as int) as sector_pos, case when b % 9 = 0 then 'Other things' when b % 7 = 0 then 'Twin' when b = 11 then cast(null as string) else concat('Brothers ', cast(b as string)) end as sector, cast(k as int) as sub_pos, case when k % 8 = 0 then 'Same' else concat('Sub ', cast(k as string)) end as sub_sector from (select p_partkey % 21 as b, row_number() over (partition by p_partkey % 21 order by p_partkey) - 1 as k from part) z""",
    "v_taxonomy_new": """select sector_pos, case when sector = 'ASIA' then 'OCEANIA' else sector end as sector, sub_pos, sub_sector from v_taxonomy""",
    "v_research": """select lpad(cast(d.doc_id as string), 8, '0') as company_number, concat('Company ', cast(d.doc_id as string)) as company_name, case when d.doc_id % 4 = 0 then cast(null as string) else concat(d.source, '.example.com') end as domain, case when d.doc_id % 13 = 0 then cast(null as string) when d.doc_id % 17 = 0 then 'INSUFFICIENT_DATA' else d.text end as services_description, case when l.doc_id is null then cast(null as string) when l.quality = 1 and d.doc_id % 6 < 5 then (select max(r_name) from region r where r.r_regionkey = d.doc_id % 6) else 'UNCLASSIFIED' end as sector, case when d.doc_id % 23 = 0 then 'scrape: timeout' end as error_log, case when d.doc_id % 3 = 0 then 1 else 0 end as sampled_for_discovery, case when l.doc_id is null then cast(null as int) else 1 + cast(d.doc_id % 2 as int) end as taxonomy_version_id, e.ts as processed_at from documents d left join labels l on l.doc_id = d.doc_id left join events e on e.event_id = d.doc_id""",
    "v_calls": """select event_id as seq, ts, user_id as company_id, case event_type when 'click' then 'search' when 'view' then 'small_model' when 'signup' then 'guess' when 'purchase' then 'large_model' else 'failed' end as service, case when event_type = 'error' then 'UNCLASSIFIED' else 'placed' end as outcome from events""",
    "v_proposals": """select c_custkey as company_number, case when c_custkey % 10 = 0 then 'UNCLASSIFIED' when c_custkey % 10 = 1 then 'ATLANTIS' when c_custkey % 10 = 2 then cast(null as string) else r_name end as sector, case when c_custkey % 10 = 3 then cast(null as string) when c_custkey % 10 = 4 then 'NATION_X' else n_name end as sub_sector, case c_custkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_custkey % 19 <> 0""",
    "v_slug_base": """select p_partkey, concat(replace(lower(concat(p_name, p_type, case p_partkey % 3 when 0 then '' when 1 then 'parts' else 'partsworkstrading' end)), ' ', ''), case p_partkey % 6 when 2 then 'margate' when 4 then 'son' else '' end) as slug from part""",
    "v_host_probe": """select host, case when substr(md5(host), 1, 1) in ('0', '1', '2', '3', '4') then 200 when substr(md5(host), 1, 1) in ('5', '6') then 301 when substr(md5(host), 1, 1) in ('7', '8', '9') then 404 else 503 end as status_code from (select distinct concat(slug, '.', tld) as host from v_slug_base cross join (select 'co.uk' as tld union all select 'com' union all select 'uk' union all select 'org.uk') t where p_partkey % 4 <> 0) z where substr(md5(host), 2, 1) in ('0', '1', '2', '3', '4', '5')""",
    "v_search_hits": """select p_partkey as company_seq, h.query_no, h.rank, case h.k when 1 then concat('https://www.linkedin.com/company/', slug) when 2 then '' when 3 then concat('https://uk.', slug, '.example.com/') when 4 then concat('https://WWW.', slug, '.co.uk/about?x=1') when 5 then concat('https://www.', slug, '.co.uk/about?x=1') else concat('http://', slug, '.com') end as link from v_slug_base cross join (select 1 as k, 1 as query_no, 1 as rank union all select 2, 1, 2 union all select 3, 1, 3 union all select 4, 2, 1 union all select 5, 2, 2 union all select 6, 3, 1) h where p_partkey % 10 <> h.k""",
    "v_lex_taxonomy": """select dense_rank() over (order by a) - 1 as sector_pos, a as sector, row_number() over (partition by a order by b) - 1 as sub_pos, b as sub_sector from (select distinct split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part) z""",
    "v_lex_companies": """select cast(p_partkey as string) as company_number, case when p_partkey % 9 = 0 then 'nothing here' when p_partkey % 29 = 0 then 'INSUFFICIENT_DATA' when p_partkey % 31 = 0 then cast(null as string) else lower(concat(p_name, ' ', p_type, ' supplies')) end as services_description from part""",
}

# Views other views read.
VIEW_DEPS = {
    "v_taxonomy_new": ["v_taxonomy"],
    "v_host_probe": ["v_slug_base"],
    "v_search_hits": ["v_slug_base"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def with_views(names, body: str) -> str:
    """Prefix an oracle query with the CTEs of the views it reads (DuckDB text)."""
    names = _closure(names)
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {ctes}\n{body}"


_RELATIONS: dict[tuple, DataFrame] = {}


class Fixtures:
    """Temp views over one scale-factor folder for a Spark session.

    Parquet relations are created once per (session, folder) and re-bound
    as temp views on each use, so repeated runs skip file listing.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # Checks write state and checkpoints: use the session's shared folder,
        # or create a local one only when the session names none (tests).
        ensure_checkpoint_dir(spark)
        app = spark.sparkContext.applicationId
        for t in BASE_TABLES:
            key = (id(spark), app, sf_dir, t)
            if key not in _RELATIONS or _RELATIONS[key].sparkSession is not spark:
                path = os.path.join(sf_dir, f"{t}.parquet")
                if not path_exists(spark, path):
                    continue
                _RELATIONS[key] = spark.read.parquet(path)
            _RELATIONS[key].createOrReplaceTempView(t)
        self._done: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def view(self, name: str) -> DataFrame:
        for n in _closure([name]):
            if n not in self._done:
                self.spark.sql(VIEWS[n]).createOrReplaceTempView(n)
                self._done.add(n)
        return self.spark.table(name)

    def sql(self, views, body: str) -> DataFrame:
        for v in views:
            self.view(v)
        return self.spark.sql(body)
