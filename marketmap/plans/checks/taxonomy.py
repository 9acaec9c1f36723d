"""Checks for TAX1-12."""

from pyspark.sql import functions as F

from marketmap.constants import BANNED_WORDS, TOKEN_STOP_WORDS
from marketmap.operators import taxonomy as T
from marketmap.operators.sequence import dense_index
from marketmap.operators.services import eligible_services
from marketmap.plans.registry import register
from marketmap.sources import taxonomy_store as TS

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in TOKEN_STOP_WORDS) + "]"
BANNED_VALUES = ", ".join(f"({i}, '{w}')" for i, w in enumerate(BANNED_WORDS))


def terms_sql(x):
    return (f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), "
            f"lambda t: length(t) >= 3 and not list_contains({STOP_SQL}, t)))")


def not_banned_sql(x):
    return " and ".join(f"strpos({x}, '{w}') = 0" for w in BANNED_WORDS)


def usable_sql(x):
    return f"({x} is not null and {x} <> '' and {x} <> 'INSUFFICIENT_DATA')"


@register("taxonomy_flat", views=["v_taxonomy"], oracle="""
select sector_pos, sector, cast(null as varchar) as sector_description, sub_pos, sub_sector,
  cast(null as varchar) as sub_description from v_taxonomy""")
def _flat(fx):
    text = TS.to_json_text(TS.nest(fx.view("v_taxonomy")))
    doc = text.select(F.from_json("taxonomy_json", TS.TAXONOMY_TYPE).alias("d")) \
        .select("d.sectors")
    return T.flatten(doc)


@register("sector_names", views=["v_taxonomy"],
          oracle="select distinct sector_pos, sector from v_taxonomy order by sector_pos")
def _names(fx):
    return T.sector_names(fx.view("v_taxonomy"))


@register("sub_sectors", views=["v_taxonomy_bad"], oracle="""
select t.sector, t.sub_pos, t.sub_sector from v_taxonomy_bad t
join (select sector, min(sector_pos) as p from v_taxonomy_bad where sector is not null group by sector) f
  on f.sector = t.sector and f.p = t.sector_pos
where t.sub_pos is not null""")
def _subs(fx):
    return T.sub_sectors(fx.view("v_taxonomy_bad"))


ERRORS_SQL = """
, s as (select sector_pos, min(sector) as sector from v_taxonomy_bad group by sector_pos),
named as (select * from s where sector is not null and sector <> ''),
subs as (select t.* from v_taxonomy_bad t join named n on n.sector_pos = t.sector_pos where t.sub_pos is not null)
select cast(null as int) as sector_pos, cast(null as int) as sub_pos,
  printf('expected exactly %d sectors, got %d', {expected}, n) as error
from (select count(*) as n from s) c where n <> {expected}
union all
select sector_pos, null, printf('sector[%d] has no name', sector_pos) from s
where sector is null or sector = ''
union all
select sector_pos, null, printf('sector ''%s'' contains banned word ''%s''', sector, word)
from named join (values BANNED) b(word_pos, word) on strpos(lower(sector), word) > 0
union all
select sector_pos, null, printf('duplicate sector name ''%s''', sector) from (
  select *, row_number() over (partition by sector order by sector_pos) as rn from named) d where rn > 1
union all
select sector_pos, null, printf('sector ''%s'' has %d sub-sectors (max 20)', sector, count(*))
from subs group by sector_pos, sector having count(*) > 20
union all
select sector_pos, sub_pos, printf('sector ''%s'' sub_sector[%d] has no name', sector, sub_pos)
from subs where sub_sector is null or sub_sector = ''
union all
select sector_pos, sub_pos, printf('duplicate sub-sector ''%s'' in sector ''%s''', sub_sector, sector) from (
  select *, row_number() over (partition by sector_pos, sub_sector order by sub_pos) as rn
  from subs where sub_sector is not null and sub_sector <> '') d where rn > 1""".replace(
    "BANNED", BANNED_VALUES)


@register("taxonomy_errors", views=["v_taxonomy_bad"],
          oracle=ERRORS_SQL.replace("{expected}", "20"))
def _errors(fx):
    return T.validate(fx.view("v_taxonomy_bad"), expected=20)


@register("taxonomy_errors_valid", views=["v_taxonomy"],
          oracle=ERRORS_SQL.replace("{expected}", "5").replace("v_taxonomy_bad", "v_taxonomy"))
def _errors_valid(fx):
    return T.validate(fx.view("v_taxonomy"), expected=5)


SHAPES_SQL = """
, s as (select cast(row_number() over (order by p_partkey) - 1 as int) as i, p_partkey as k, p_partkey % 6 as m
  from v_shape_elements)
select cast(null as int) as sector_pos, cast(null as int) as sub_pos,
  printf('expected exactly 20 sectors, got %d', count(*)) as error from s having count(*) <> 20
union all select i, null, printf('sector[%d] is not a dict', i) from s where m = 0
union all select i, null, printf('sector[%d] has no name', i) from s where m = 1
union all select i, null, printf('sector ''Field %d'' sub_sectors is not a list', k) from s where m in (2, 5)
union all select i, cast(0 as int), printf('sector ''Field %d'' sub_sector[0] not a dict', k) from s where m = 3
union all select i, cast(2 as int), printf('sector ''Field %d'' sub_sector[2] has no name', k) from s where m = 3
union all select i, cast(3 as int), printf('duplicate sub-sector ''A'' in sector ''Field %d''', k) from s where m = 3
union all select i, null, printf('sector ''Other %d'' contains banned word ''other''', k) from s where m = 4"""


@register("taxonomy_shape_errors", views=["v_shape_elements"], oracle=SHAPES_SQL)
def _shape_errors(fx):
    elements = dense_index(fx.view("v_shape_elements"), ["p_partkey"])
    return T.validate_elements(elements.withColumn("sector_pos", F.col("seq") - 1))


@register("taxonomy_diff", views=["v_taxonomy", "v_taxonomy_new"], oracle="""
, o as (select distinct sector from v_taxonomy where sector is not null),
n as (select distinct sector from v_taxonomy_new where sector is not null)
select 'lost' as change, sector from (select sector from o except select sector from n) a
union all
select 'added', sector from (select sector from n except select sector from o) b""")
def _diff(fx):
    return T.diff(fx.view("v_taxonomy"), fx.view("v_taxonomy_new"))


DESCRIBED_SQL = """select sector_pos, sector,
  case when sector_pos % 2 = 0 then 'Region ' || lower(sector) end as sector_description,
  sub_pos, sub_sector, case when sub_pos % 2 = 1 then 'made in ' || lower(sub_sector) end as sub_description
from v_taxonomy"""


@register("taxonomy_text", views=["v_taxonomy"], oracle=f"""
, d as ({DESCRIBED_SQL})
select sector_pos, 'SECTOR: ' || coalesce(min(sector), '') || chr(10)
  || coalesce(max(case when coalesce(sector_description, '') <> '' then '  (' || sector_description || ')' || chr(10) end), '')
  || coalesce(string_agg(case when sub_pos is not null then
       case when coalesce(sub_description, '') <> '' then '  - ' || coalesce(sub_sector, '') || ' — ' || sub_description
            else '  - ' || coalesce(sub_sector, '') end || chr(10) end, '' order by sub_pos), '') as block
from d group by sector_pos""")
def _text(fx):
    return T.render_blocks(fx.sql(["v_taxonomy"], DESCRIBED_SQL))


def _change_logs(fx):
    t = fx.view("v_taxonomy")
    s, u = F.col("sector"), F.col("sub_sector")
    k = F.col("sub_pos") % 5
    entry = (F.when(k == 0, F.format_string(
                '{"type": "added_sub_sector", "sector": "%s", "sub_sector": "%s", "reason": "gap in %s"}', s, u, s))
             .when(k == 1, F.format_string(
                 '{"type": "renamed_sub_sector", "sector": "%s", "from": "%s", "to": "%s", "reason": "clearer"}',
                 s, u, F.lower(u)))
             .when(k == 2, F.format_string(
                 '{"type": "merged_sub_sectors", "sector": "%s", "merged": ["%s", "%s"], "into": "%s", "reason": "overlap"}',
                 s, u, F.lower(u), u))
             .when(k == 3, F.format_string(
                 '{"type": "new_sector", "name": "%s", "replaces": "%s", "reason": "new theme"}', u, s))
             .otherwise(F.format_string('{"type": "split_sector", "sector": "%s", "sub_sector": "%s"}', s, u)))
    logs = t.groupBy(F.col("sector_pos").alias("version_id")).agg(F.concat(
        F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("sub_pos", entry.alias("e")))), lambda x: x["e"]), ", "), F.lit("]"))
        .alias("change_log"))
    empty = t.agg((F.max("sector_pos") + 1).alias("version_id")) \
        .select(F.col("version_id").cast("int"), F.lit(None).cast("string").alias("change_log"))
    return logs.unionByName(empty)


CHANGE_LOGS_SQL = """select sector_pos as version_id, '[' || string_agg(case sub_pos % 5
  when 0 then '{"type": "added_sub_sector", "sector": "' || sector || '", "sub_sector": "' || sub_sector || '", "reason": "gap in ' || sector || '"}'
  when 1 then '{"type": "renamed_sub_sector", "sector": "' || sector || '", "from": "' || sub_sector || '", "to": "' || lower(sub_sector) || '", "reason": "clearer"}'
  when 2 then '{"type": "merged_sub_sectors", "sector": "' || sector || '", "merged": ["' || sub_sector || '", "' || lower(sub_sector) || '"], "into": "' || sub_sector || '", "reason": "overlap"}'
  when 3 then '{"type": "new_sector", "name": "' || sub_sector || '", "replaces": "' || sector || '", "reason": "new theme"}'
  else '{"type": "split_sector", "sector": "' || sector || '", "sub_sector": "' || sub_sector || '"}' end, ', ' order by sub_pos) || ']' as change_log
from v_taxonomy group by sector_pos
union all select max(sector_pos) + 1, null from v_taxonomy"""


@register("change_log_lines", views=["v_taxonomy"], oracle=f"""
, logs as ({CHANGE_LOGS_SQL}),
e as (select version_id, cast(i - 1 as int) as entry_no, l[i] as e
      from (select version_id, json_extract(change_log, '$[*]') as l from logs where change_log is not null) a,
      range(1, len(l) + 1) r(i))
select version_id, entry_no, case json_extract_string(e, '$.type')
  when 'added_sub_sector' then printf('  + Added sub-sector ''%s'' to sector ''%s'' — %s',
    json_extract_string(e, '$.sub_sector'), json_extract_string(e, '$.sector'), coalesce(json_extract_string(e, '$.reason'), ''))
  when 'renamed_sub_sector' then printf('  ~ Renamed ''%s'' → ''%s'' in sector ''%s'' — %s',
    json_extract_string(e, '$.from'), json_extract_string(e, '$.to'), json_extract_string(e, '$.sector'), coalesce(json_extract_string(e, '$.reason'), ''))
  when 'merged_sub_sectors' then printf('  ⋈ Merged %s → ''%s'' in sector ''%s'' — %s',
    '[' || array_to_string(list_transform(json_extract_string(e, '$.merged[*]'), lambda x: '''' || x || ''''), ', ') || ']',
    json_extract_string(e, '$.into'), json_extract_string(e, '$.sector'), coalesce(json_extract_string(e, '$.reason'), ''))
  when 'new_sector' then printf('  ★ New sector ''%s'' (replaces ''%s'') — %s',
    json_extract_string(e, '$.name'), json_extract_string(e, '$.replaces'), coalesce(json_extract_string(e, '$.reason'), ''))
  else printf('  - %s: %s', coalesce(json_extract_string(e, '$.type'), '?'),
    '{{' || array_to_string(list_transform(json_keys(e), lambda k: '''' || k || ''': ' ||
      coalesce('''' || json_extract_string(e, '$."' || k || '"') || '''', 'None')), ', ') || '}}') end as line
from e
union all
select version_id, cast(0 as int), '(none reported)' from logs where change_log is null""")
def _change_lines(fx):
    return T.change_log_lines(_change_logs(fx))


@register("description_batches", views=["v_research"], oracle="""
, e as (select company_number, company_name, services_description,
          row_number() over (order by company_number) as idx
        from v_research where sampled_for_discovery = 1 and services_description is not null
          and services_description <> 'INSUFFICIENT_DATA')
select cast(floor((idx - 1) / 100) as bigint) as batch_no, count(*) as n,
  string_agg('[' || coalesce(company_name, 'None') || ']: ' || coalesce(services_description, ''), chr(10) order by idx) as block
from e group by 1""")
def _batches(fx):
    return T.description_batches(eligible_services(fx.view("v_research")))


CONTEXT_SQL = """select company_number, company_name, services_description, sector,
  cast(null as varchar) as sub_sector
from v_research
where sector is not null and sector <> 'UNCLASSIFIED'
  and taxonomy_version_id = (select max(taxonomy_version_id) from v_research)
order by md5('42:' || company_number), company_number limit 200"""


@register("refresh_context", views=["v_research"], oracle=f"""
, c as ({CONTEXT_SQL})
select count(*) as n, string_agg(printf('[%s] (%s / %s): %s', coalesce(company_name, 'None'),
  coalesce(sector, 'None'), coalesce(sub_sector, 'None'), coalesce(services_description, '')),
  chr(10) order by md5('42:' || company_number), company_number) as block from c""")
def _context(fx):
    from marketmap.operators.refresh import context_sample
    st = fx.view("v_research")
    s = context_sample(st, latest_version_of(st))
    return T.refresh_context(s.withColumn("_order", F.struct("_h", "company_number")))


def latest_version_of(state):
    return state.agg(F.max("taxonomy_version_id").alias("version_id"))


GAP_SQL = f"""
, pos as (select sector, min(sector_pos) as sector_pos from v_taxonomy where sector is not null group by sector),
placed as (select p.sector_pos, unnest({terms_sql('r.services_description')}) as term
  from v_research r join pos p on p.sector = r.sector
  where r.sector <> 'UNCLASSIFIED' and {usable_sql('r.services_description')}),
vocab as (select sector_pos, term, count(*) as pc from placed group by sector_pos, term),
gap as (select company_number, unnest({terms_sql('services_description')}) as term
  from v_research where sector = 'UNCLASSIFIED' and {usable_sql('services_description')}),
support as (select term, count(*) as support from gap group by term
  having count(*) >= 3 and {not_banned_sql('term')}),
overlap as (select g.company_number, v.sector_pos, count(*) as shared from gap g join vocab v on v.term = g.term
  group by g.company_number, v.sector_pos),
best as (select company_number, sector_pos from (select *, row_number() over
  (partition by company_number order by shared desc, sector_pos) as r from overlap) z where r = 1),
votes as (select g.term, b.sector_pos, count(*) as score from gap g join support s on s.term = g.term
  join best b on b.company_number = g.company_number group by g.term, b.sector_pos),
chosen as (select term, sector_pos, score from (select *, row_number() over
  (partition by term order by score desc, sector_pos) as r from votes) z where r = 1),
names as (select sector_pos, min(sector) as sector from v_taxonomy group by sector_pos)
select c.term, s.support, c.sector_pos, n.sector, c.score,
  cast(row_number() over (partition by c.sector_pos order by s.support desc, c.term) as int) as rank
from chosen c join support s on s.term = c.term join names n on n.sector_pos = c.sector_pos"""


@register("gap_terms", views=["v_research", "v_taxonomy"], oracle=GAP_SQL)
def _gap_terms(fx):
    return T.gap_terms(fx.view("v_research"), fx.view("v_taxonomy"), 3)


GAP_CTES, GAP_SELECT = GAP_SQL.rsplit("\nselect c.term,", 1)


@register("taxonomy_refresh", views=["v_research", "v_taxonomy"], oracle=f"""{GAP_CTES},
g as (select c.term,{GAP_SELECT}),
have as (select sector_pos, count(sub_pos) as n, max(sub_pos) as last from v_taxonomy group by sector_pos),
fresh as (select g.sector_pos, g.sector, g.term, row_number() over (partition by g.sector_pos order by g.support desc, g.term) as r
  from g where strpos(lower(g.sector), g.term) = 0 and not exists (select 1 from v_taxonomy t
    where t.sector_pos = g.sector_pos and lower(t.sub_sector) = g.term))
select sector_pos, sector, cast(null as varchar) as sector_description, sub_pos, sub_sector,
  cast(null as varchar) as sub_description, false as added from v_taxonomy
union all
select f.sector_pos, f.sector, null, cast(coalesce(h.last, -1) + f.r as int),
  upper(f.term[1]) || f.term[2:], null, true
from fresh f join have h on h.sector_pos = f.sector_pos where f.r <= 20 - h.n""")
def _refresh(fx):
    new_flat, log = T.refresh_by_gap(fx.view("v_research"), fx.view("v_taxonomy"), 3)
    return new_flat


@register("taxonomy_discover", views=["v_research"])
def _discover(fx):
    flat, _ = T.discover(eligible_services(fx.view("v_research")))
    return flat


REFINE_BATCH, REFINE_SUPPORT = 100, 3


@register("taxonomy_refine", views=["v_research", "v_taxonomy"], oracle=f"""
, d as (select company_number, {terms_sql("services_description")} as t from v_research
  where {usable_sql("services_description")}),
assigned as (select t, cast(company_number as bigint) % 5 as sector_pos,
    (row_number() over (order by company_number) - 1) // {REFINE_BATCH} as batch_no from d where len(t) > 0),
per as (select sector_pos, term, batch_no, count(*) as n from (select sector_pos, batch_no, unnest(t) as term from assigned)
  where {not_banned_sql("term")} group by 1, 2, 3),
so_far as (select *, sum(n) over (partition by sector_pos, term order by batch_no) as support from per),
reached as (select sector_pos, term, min(batch_no) as batch_no, min(support) as support from so_far
  where support >= {REFINE_SUPPORT} group by 1, 2),
sec as (select sector_pos, sector, count(sub_pos) as have, max(sub_pos) as last from v_taxonomy group by 1, 2),
fresh as (select r.*, s.sector, s.have, s.last,
    row_number() over (partition by r.sector_pos order by batch_no, support desc, term) as k
  from reached r join sec s on s.sector_pos = r.sector_pos
  where strpos(lower(s.sector), term) = 0 and not exists (
    select 1 from v_taxonomy x where x.sector_pos = r.sector_pos and lower(x.sub_sector) = term))
select sector_pos as cluster, sector_pos, sector, sub_pos, sub_sector, false as added from v_taxonomy
union all select cast(sector_pos as int), cast(sector_pos as int), sector, cast(last + k as int),
  upper(term[1]) || term[2:], true from fresh where k <= 20 - have""")
def _refine(fx):
    """TAX11 over batches of a fixed assignment (rows to sectors by their number)."""
    d = T.described_terms(fx.view("v_research"))
    rows = T.dense_index(d, ["company_number"], "_idx").select(
        (F.col("company_number").cast("bigint") % 5).cast("int").alias("cluster"),
        F.floor((F.col("_idx") - 1) / REFINE_BATCH).alias("batch_no"), "terms")
    flat = fx.view("v_taxonomy").withColumn("cluster", F.col("sector_pos"))
    return T.refine_batches(flat, rows, REFINE_SUPPORT).select(
        "cluster", "sector_pos", "sector", "sub_pos", "sub_sector", "added")


@register("taxonomy_discover_refined", views=["v_research"])
def _discover_refined(fx):
    """TAX10-11: the sample's taxonomy, refined by the batches of the other descriptions."""
    st = fx.view("v_research")
    flat, model = T.discover(eligible_services(st))
    return T.refine(flat, model, st.filter(F.col("sampled_for_discovery") == 0))
