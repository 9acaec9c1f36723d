"""Centroid clustering, repetition rules and periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from marketmap.llm import centroid_clustering as cc
from marketmap.llm import periodic_runs as pr
from marketmap.llm import repetition as rp
from marketmap.llm.queries import op13_periodic_runs
from tests.llm.conftest import ODD

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- op11 ----

def lloyd(rows, k, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by full scans in Python integers."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:k]]

    def assign():
        out = []
        for _, v in kept:
            ds = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(range(len(ds)), key=lambda j: (ds[j], j)), min(ds)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (a, _) in zip(kept, got) if a == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    per = [sum(d for a, d in got if a == j) for j in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, d, per[a], sum(per), marks[a]) for (i, _), (a, d) in zip(kept, got)), key=str)


def clusters(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).selectExpr("*", "'x' as cluster", "1 as dist", "2 as seen")
    out = cc.centroid_clusters(df, **kw)
    return sorted((tuple(r)[:6] for r in out.collect()), key=str), out


def test_clusters_equal_full_scans(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 64))
    rows = [(int(i), (centres[i % 20] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])] + [(1000 + i, rows[0][1]) for i in range(300)]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 63 + [None]), (2004, [0.5] * 63 + [float("nan")]),
             (2005, [0.5] * 63 + [float("inf")]), (2006, [0.0] * 64), (2007, [-1e-9] * 64)]
    got, df = clusters(spark, rows)
    assert got == lloyd(rows, 16, 3, 64)
    # The bounds spare distances: a full scan each round would compute 16 x 4 for every vector.
    assert df.agg({"n_scans": "avg"}).first()[0] < 0.75 * 64


def test_clusters_of_ties_and_few_vectors(spark):
    same = [(i, [1.0] * 64) for i in range(30)]
    assert clusters(spark, same)[0] == lloyd(same, 16, 3, 64)
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [0.25] * 64)]
    assert clusters(spark, few)[0] == lloyd(few, 16, 3, 64)
    grid = [(i, [float(i % 5), float(i % 3), 0.5, -float(i % 7)]) for i in range(200)]
    assert clusters(spark, grid, dimension=4, k=6, rounds=6)[0] == lloyd(grid, 6, 6, 4)
    assert clusters(spark, [])[0] == [] and clusters(spark, [(1, None)])[0] == []


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        clusters(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])


def test_bounds_use_the_whole_displacement():
    """Centroids that move there and back leave the stored bounds as they were; summed moves would have failed."""
    rng = np.random.default_rng(1)
    home = np.array([[0, 0], [1000, 0], [0, 1000]])
    x = np.concatenate([h + rng.integers(-20, 20, (50, 2)) for h in home])
    own, dist, seen, _ = cc.first_assignment(x, home)
    away = home + np.array([[0, 450], [0, 450], [0, 450]])
    got, dist, seen, scans = cc.bounded_assignment(x, own, dist.copy(), seen.copy(), [home, away, home])
    assert (got == own).all() and scans.sum() == 0 and (seen == 0).all()


# ---- op12 ----

def repeats_by_hand(words, least):
    """Maximal repeated substrings as (length, starts)."""
    n, out = len(words), set()
    for length in range(least, n):
        places = {}
        for i in range(n - length + 1):
            places.setdefault(tuple(words[i:i + length]), []).append(i)
        for at in places.values():
            if len(at) < 2:
                continue
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + length] if i + length < n else ("end",) for i in at}
            if (len(before) > 1 or None in before) and (len(after) > 1 or ("end",) in after):
                out.add((length, tuple(at)))
    return out


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            words += words[:rng.randrange(len(words) + 1)]
        for least in (1, 2, 4):
            got = {(r.length, r.starts) for r in rp.maximal_repeats(words, least)}
            assert got == repeats_by_hand(words, least), (words, least)


def test_lcp_equals_direct_comparison():
    rng = random.Random(5)
    for _ in range(100):
        ids = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 80))] * rng.randrange(1, 4))
        order, levels = rp.suffix_order(ids)
        suffixes = [ids[i:].tolist() for i in range(len(ids))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        lcp = rp.shared_prefixes(order, levels)
        for r in range(1, len(ids)):
            a, b = suffixes[order[r - 1]], suffixes[order[r]]
            assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


LINE = "one line of quite ordinary words that is said again and again below here now"


def quality_rows():
    rng = random.Random(8)

    def prose(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]

    passage = prose(120)
    return ODD + [(20, " ".join(prose(200))), (21, " ".join(prose(100) + passage + prose(300) + passage + prose(600))),
                  (22, "\n".join([LINE] + prose(150) + [LINE])), (23, "\n".join([LINE, " ".join(prose(20)), ""] * 9)),
                  (24, " ".join(prose(60)) + " a|b <c> # $"), (25, "x y z\n \nx y z\n\n\t\nX y z " + " ".join(prose(50))),
                  (26, " ".join(["é日"] * 3 + prose(70)) + "\x85\x1c "), (27, " ".join((prose(25) * 2) + prose(60)))]


def test_quality_equals_the_sql(spark, docs_of):
    rows = quality_rows()
    got = rp.quality_by_repetition(docs_of(rows)).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    want = con.sql(rp.ORACLE_SQL)
    assert sorted((tuple(r[c] for c in want.columns) for r in got), key=str) == sorted(want.fetchall(), key=str)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[20] and kept[22] and kept[24] and not kept[21] and not kept[23] and not kept[5]
    assert rp.quality_by_repetition(docs_of([])).collect() == []


def test_texts_sorted_together_are_judged_alone(monkeypatch, docs_of):
    rows = quality_rows()
    whole = rp.quality_by_repetition(docs_of(rows)).collect()
    words = [(t or "").encode().split() for _, t in rows]
    together, alone = rp.repetition_of(words), [rp.repetition_of([w]) for w in words]
    for k in range(4):
        assert together[k].tolist() == [a[k][0] for a in alone]
    assert len(whole) == len(rows)


# ---- op13 ----

def runs_by_hand(words):
    """(start, length, period) by comparing every word with the one a period on."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(24, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def result_by_hand(words):
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed.encode()).hexdigest())


def periodic_texts(count, seed=3):
    rng = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 40))]
            length = rng.randrange(1, 200)
            words += (unit * (length // len(unit) + 1))[:length] if rng.random() < 0.7 else unit
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "z"
        yield words


def test_runs_equal_brute_force(docs_of):
    rows = [(i, " ".join(w)) for i, w in enumerate(periodic_texts(250), 1000)]
    rows += [*ODD, (100, "a " * 23), (101, "a " * 24), (102, "a b c\td\ne\x0bf g h " * 3), (103, " ".join(map(str, range(100)))),
             (104, ("é \x85 日 " * 30)), (105, " ".join((list("abcdefgh") * 3)[:23])), (101, "a " * 24)]
    got = sorted((tuple(r) for r in pr.periodic_runs(docs_of(rows).repartition(5)).collect()), key=str)
    want = sorted(((i, *result_by_hand([w.decode() for w in (t or "").encode().split()])) for i, t in rows if i != 5), key=str)
    assert [g for g in got if g[0] != 5] == want
    assert [g[1:6] for g in got if g[0] == 5] == [(1, 0, 30000, 1, 30000000)]
    assert pr.periodic_runs(docs_of([])).collect() == []


def test_long_periods_across_many_tiles(docs_of):
    rng = random.Random(6)
    unit = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    head = [f"h{i}" for i in range(1234)]
    text = " ".join(head + unit * 4 + unit[:17] + ["end"])
    (row,) = pr.periodic_runs(docs_of([(1, text)])).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 1234, 12017, 3000)
    assert row["collapsed_sha256"] == hashlib.sha256(" ".join(head + unit + ["end"]).encode()).hexdigest()
    found = pr.runs_of(docs_of([(1, text), (1, "a " * 30)])).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 30, 1), (1, 1234, 12017, 3000)]


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_on_planted_periods_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and sum(1 for g in got.values() if g[0]) > 5
    for r in rows:
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        if len(words) < 2500:
            assert got[r["doc_id"]] == result_by_hand(planted(r["doc_id"], words)), r["doc_id"]
