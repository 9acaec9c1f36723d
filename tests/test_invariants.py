"""Invariants: sample sizes, taxonomy validity, refresh never renames, stream == batch."""

from pyspark.sql import functions as F

from marketmap.operators import sampling as SM
from marketmap.operators import taxonomy as T
from marketmap.operators.classify import classify_lexical, validate_proposals
from marketmap.operators.services import eligible_services
from marketmap.plans.fixtures import Fixtures
from marketmap.sources import companies as C
from marketmap.sources import taxonomy_store as TS
from tests.conftest import SF_MID, SF_SMALL
from tests.harness import compare


def companies(spark, sf=SF_MID):
    return C.load_companies(Fixtures(spark, sf).view("v_companies_raw"))


def test_sample_size_exact(spark):
    c = companies(spark)
    rows = c.count()
    for n in [1, 7, 100, 250, rows - 1, rows, rows + 10]:
        s = SM.stratified_sample(c, n)
        assert s.count() == min(n, rows)
        assert s.select("company_number").distinct().count() == min(n, rows)


def test_sample_is_proportional(spark):
    c = companies(spark)
    n = 300
    s = SM.stratified_sample(c, n)
    area = F.coalesce(F.col("area"), F.lit("_NONE_"))
    total = c.count()
    pop = {r["area"]: r["count"] for r in SM.stratified_sample(c, total).groupBy(area.alias("area")).count().collect()}
    got = {r["area"]: r["count"] for r in s.groupBy(area.alias("area")).count().collect()}
    for a, k in pop.items():
        quota = min(round(n * (k / total)), k)
        assert abs(got.get(a, 0) - quota) <= len(pop), (a, got.get(a), quota)


def test_sample_repeatable(spark):
    c = companies(spark)
    a = sorted(r[0] for r in SM.stratified_sample(c, 50).select("company_number").collect())
    b = sorted(r[0] for r in SM.stratified_sample(c, 50).select("company_number").collect())
    assert a == b


def test_discovered_taxonomy_is_valid_and_refinement_adds(spark):
    fx = Fixtures(spark, SF_MID)
    rows = eligible_services(fx.view("v_research"))
    flat, model = T.discover(rows.repartition(2))
    errors = T.validate(flat).collect()
    assert errors == [], errors[:5]
    # The same taxonomy however the rows lie.
    again, _ = T.discover(rows.repartition(23, "company_name"))
    assert sorted(map(str, flat.collect())) == sorted(map(str, again.collect()))
    refined = T.refine(flat, model, fx.view("v_research")).checkpoint(eager=True)
    assert T.validate(refined).collect() == []
    assert T.diff(flat, refined).count() == 0
    assert refined.filter("added").count() > 0 and refined.filter("not added").count() == flat.count()
    more = T.refine(refined.drop("added"), model, fx.view("v_research"))
    assert more.groupBy("sector_pos").count().agg({"count": "max"}).first()[0] <= 20


def fold(flat, batches, support):
    """TAX11 as a loop: one batch after the other on what the last one left."""
    flat, seen, added = [list(r) for r in flat], {}, []
    for batch in batches:
        mentioned = {}
        for cluster, terms in batch:
            for t in terms:
                seen[cluster, t] = seen.get((cluster, t), 0) + 1
                mentioned[cluster, t] = seen[cluster, t]
        for (c, t), n in sorted(mentioned.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
            mine = [r for r in flat if r[0] == c and r[3] is not None]
            name = next(r[2] for r in flat if r[0] == c)
            if n >= support and t not in [r[4].lower() for r in mine] and t not in name.lower() and len(mine) < 20:
                flat.append([c, c, name, max((r[3] for r in mine), default=-1) + 1, t.capitalize()])
                added.append((c, flat[-1][3], flat[-1][4]))
    return added


def test_refinement_equals_a_fold_over_batches(spark):
    import random
    rng = random.Random(11)
    flat = [(0, 0, "Term1 & Co", 0, "Term2"), (0, 0, "Term1 & Co", 1, "Term3"), (1, 1, "Empty", None, None)]
    batches = [[(rng.randrange(2), sorted({f"term{min(rng.randrange(60), rng.randrange(60))}" for _ in range(4)}))
                for _ in range(12)] for _ in range(8)]
    rows = [(c, i, t) for i, b in enumerate(batches) for c, t in b]
    got = T.refine_batches(
        spark.createDataFrame(flat, "cluster int, sector_pos int, sector string, sub_pos int, sub_sector string"),
        spark.createDataFrame(rows, "cluster int, batch_no long, terms array<string>"), 2)
    assert sorted((r["cluster"], r["sub_pos"], r["sub_sector"]) for r in got.filter("added").collect()) == \
        sorted(fold(flat, batches, 2))


def test_refresh_never_renames(spark):
    fx = Fixtures(spark, SF_MID)
    tax = fx.view("v_taxonomy")
    new_flat, log = T.refresh_by_gap(fx.view("v_research"), tax, 3)
    assert T.diff(tax, new_flat).count() == 0
    assert T.validate(new_flat, expected=5).count() == 0
    assert log.count() == new_flat.filter("added").count()


def test_document_round_trip_and_shape(spark):
    doc = {"sectors": [{"name": "A", "description": "da",
                        "sub_sectors": [{"name": "a1"}, {"name": "a2", "description": "x"}]},
                       {"name": "B", "sub_sectors": []}]}
    flat = T.flatten(TS.taxonomy_from_python(spark, doc))
    rows = sorted((r["sector_pos"], r["sub_pos"], r["sub_sector"]) for r in flat.collect())
    assert rows == [(0, 0, "a1"), (0, 1, "a2"), (1, None, None)]
    text = T.render_text(flat).first()["text"]
    assert text == "SECTOR: A\n  (da)\n  - a1\n  - a2 — x\n\nSECTOR: B\n"
    bad = T.validate_document(TS.taxonomy_from_python(spark, {"sectors": "oops"})).collect()
    assert [r["error"] for r in bad] == ["'sectors' key missing or not a list"]


def test_every_written_name_is_verbatim(spark):
    fx = Fixtures(spark, SF_MID)
    tax = fx.view("v_lex_taxonomy")
    out = validate_proposals(classify_lexical(fx.view("v_lex_companies"), tax), tax)
    pairs = T.sub_sectors(tax).select("sector", "sub_sector")
    placed = out.filter(F.col("sector") != "UNCLASSIFIED").select("sector", "sub_sector")
    assert placed.join(pairs, ["sector", "sub_sector"], "left_anti").count() == 0
    assert out.filter((F.col("sector") == "UNCLASSIFIED") & F.col("sub_sector").isNotNull()).count() == 0


def test_stream_equals_batch(spark):
    from marketmap.plans.registry import QUERIES, load_all
    load_all()
    fx = Fixtures(spark, SF_SMALL)
    batch = classify_lexical(fx.view("v_lex_companies"), fx.view("v_lex_taxonomy")).toPandas()
    stream = QUERIES["incremental_classify"](spark, SF_SMALL).toPandas()
    ok, msg = compare(stream, batch)
    assert ok, msg


def test_top_k_grouped_path_is_exact(spark):
    from marketmap.operators import partitioning as PT
    df = spark.range(0, 20000, numPartitions=64).withColumn("h", F.md5(F.col("id").cast("string")))
    want = [r["id"] for r in df.orderBy("h", "id").limit(150).collect()]
    got = [r["id"] for r in PT.top_k(df, [F.col("h"), F.col("id")], 150).collect()]
    assert sorted(got) == sorted(want)
    assert len(got) == 150


def test_dense_index_is_a_permutation_in_order(spark):
    from marketmap.operators.sequence import dense_index
    df = spark.range(0, 30000, numPartitions=37).withColumn("k", F.md5(F.col("id").cast("string")))
    got = dense_index(df, ["k", "id"], "seq").select("id", "k", "seq").toPandas()
    got = got.sort_values("seq")
    assert list(got.seq) == list(range(1, 30001))
    assert list(got.k) == sorted(got.k)


def test_hot_key_and_hot_area(spark):
    """A key and a postcode area each holding a third of the rows."""
    n = 9000
    df = spark.range(0, n, numPartitions=16).select(
        F.col("id").alias("input_seq"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string"))
        .alias("company_number"),
        F.concat(F.lit("NAME "), F.col("id").cast("string")).alias("company_name"),
        F.when(F.col("id") % 3 == 1, F.lit("B1 1AA")).otherwise(
            F.concat(F.lit("W"), (F.col("id") % 50).cast("string"), F.lit(" 1AA"))).alias("postcode"))
    d = C.dedupe_first(df)
    hot = d.filter(F.col("company_number") == "HOT").first()
    assert hot["input_seq"] == 0 and d.count() == n - n // 3 + 1
    s = SM.stratified_sample(d, 600)
    assert s.count() == 600
    b = s.filter(F.col("area") == "B").count()
    total = d.count()
    b_all = d.filter(F.col("postcode") == "B1 1AA").count()
    assert abs(b - round(600 * (b_all / total))) <= 1


def test_replayed_batch_keeps_its_rows(spark, tmp_path):
    """A stream that starts again on the same input writes the same rows, not an empty batch."""
    from marketmap.streaming.incremental import incremental_classify
    fx = Fixtures(spark, SF_SMALL)
    rows = fx.view("v_lex_companies").limit(40).withColumn("input_seq", F.col("company_number").cast("long"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(src)
    tax = fx.view("v_lex_taxonomy")
    first = incremental_classify(spark, src, rows.schema, tax, out, str(tmp_path / "c1")).count()
    again = incremental_classify(spark, src, rows.schema, tax, out, str(tmp_path / "c2")).count()
    assert first == again == rows.select("company_number").distinct().count()
