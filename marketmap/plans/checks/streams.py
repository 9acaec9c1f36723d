"""Checks for STR1-3: each stream runs to completion (availableNow) over files
Spark derives from the driver tables, and must end equal to the batch answer."""

import os

from pyspark.sql import functions as F

from marketmap.plans import modes
from marketmap.plans.checks.classify import LEXICAL_SQL
from marketmap.plans.registry import register
from marketmap.streaming import incremental as S


def _stage(fx, view: str, name: str, files: int, order: str, extra=None):
    spark = fx.spark
    run = S.new_run_dir(spark, name)
    df = fx.view(view)
    for c, e in (extra or {}).items():
        df = df.withColumn(c, e)
    src = S.write_files(df, os.path.join(run, "input"), files, order)
    schema = spark.read.parquet(src).schema
    return run, src, schema


@register("incremental_classify", views=["v_lex_companies", "v_lex_taxonomy"], oracle=LEXICAL_SQL)
def _incremental(fx):
    run, src, schema = _stage(fx, "v_lex_companies", "classify", 20, "input_seq",
                              {"input_seq": F.col("company_number").cast("bigint")})
    return S.incremental_classify(fx.spark, src, schema, fx.view("v_lex_taxonomy"),
                                  os.path.join(run, "results"), os.path.join(run, "ckpt"),
                                  files_per_trigger=4)


@register("drift_monitor", views=["v_calls"], oracle="""
select date_trunc('day', ts) as window_start,
  count(*) filter (where outcome = 'UNCLASSIFIED') as unclassified, count(*) as total,
  count(*) filter (where outcome = 'UNCLASSIFIED') / cast(count(*) as double) as rate,
  count(*) >= 1000 and count(*) filter (where outcome = 'UNCLASSIFIED') / cast(count(*) as double) > 0.05 as trigger
from v_calls group by 1""")
def _drift(fx):
    run, src, schema = _stage(fx, "v_calls", "drift", 10, "ts")
    return S.drift_monitor(fx.spark, src, schema, os.path.join(run, "windows"),
                           os.path.join(run, "ckpt"), window="1 day", watermark="30 days")


@register("streaming_spend", views=["v_calls"], oracle="""
select c.service, c.calls, c.calls * p.unit_price_e5 / cast(100000 as double) as gbp
from (select service, count(*) as calls from v_calls group by service) c
join (values ('search', 24), ('small_model', 100), ('large_model', 1500)) p(service, unit_price_e5)
  on p.service = c.service""")
def _spend(fx):
    run, src, schema = _stage(fx, "v_calls", "spend", 10, "seq")
    return S.streaming_spend(fx.spark, src, schema, os.path.join(run, "spend"),
                             os.path.join(run, "ckpt"))


@register("drift_last_w", views=["v_research"], oracle="""
select 'all' as key, count(*) filter (where sector = 'UNCLASSIFIED') as unclassified, count(*) as total,
  count(*) filter (where sector = 'UNCLASSIFIED') / cast(greatest(count(*), 1) as double) as rate,
  count(*) >= 1000 and count(*) filter (where sector = 'UNCLASSIFIED') / cast(greatest(count(*), 1) as double) > 0.05 as trigger
from (select sector from v_research where sector is not null
      order by processed_at desc nulls last, company_number limit 1000) z""")
def _last_w(fx):
    """STR2 count-based: the stream's final last-1000 equals MON1 over the same rows."""
    run, src, schema = _stage(fx, "v_research", "lastw", 10, "company_number")
    return S.drift_last_w(fx.spark, src, schema, os.path.join(run, "lastw"),
                          os.path.join(run, "ckpt"), window=1000)


CHUNK, LAST_W = 500, 1000


@register("classify_run", views=["v_lex_companies", "v_lex_taxonomy"], oracle=f"""
, placed as (with {LEXICAL_SQL.lstrip().removeprefix(",")}),
numbered as (select sector, row_number() over (order by cast(company_number as bigint)) - 1 as i from placed),
steps as (select cast(i // {CHUNK} as int) as chunk_no, count(*) as processed,
  count(*) filter (where sector = 'UNCLASSIFIED') as u from numbered group by 1),
rolling as (select chunk_no, processed, cast(sum(u) over w as bigint) as unclassified,
  cast(sum(processed) over w as bigint) as total,
  cast(sum(processed) over (order by chunk_no) as bigint) as rows_since_refresh
  from steps window w as (order by chunk_no rows between {LAST_W // CHUNK - 1} preceding and current row))
select *, case when rows_since_refresh >= 10000 then 'scheduled'
  when total >= {LAST_W} and unclassified / cast(total as double) > 0.05 then 'unclassified_threshold' end as trigger
from rolling""")
def _classify_run(fx):
    """STR1, CLS9, MON2: chunks of pending rows placed on the patch log, the trigger after each (no refresh here)."""
    store = modes.ResearchStore(fx.spark, S.new_run_dir(fx.spark, "rollout"))
    store.save_taxonomy(fx.view("v_lex_taxonomy"), "initial", 0)
    run = modes.rollout(store, "check", window=LAST_W, auto_refresh=False)
    rows = fx.view("v_lex_companies").withColumn("input_seq", F.col("company_number").cast("bigint"))
    return run.run(run.queue(rows, CHUNK)).select(
        "chunk_no", "processed", "unclassified", "total", "rows_since_refresh", "trigger")
