"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Text is folded (lower case, homoglyphs, full-width forms and invisible characters, digits and signs
that stand for letters) and cut to its letter runs, one space apart. The lexicon's entries are words and
word beginnings with log-odds weights, mined from a bounded sample of labelled rows: an entry counts
when the lower bound of its share of toxic texts is high. Exception phrases take back the weight of the
words they cover. The summed weight, as it is and relative to the text's length, goes through a logistic
curve that is fitted on the other half of the sample.

Learned from: text and toxic of labelled rows outside the held-out fold. A score sees the text alone.
Edge cases: null, empty and letterless texts get the curve's value at zero; several labels of one
document count as their largest, null labels as none; with no labelled row, or one class only, the
lexicon is empty and every score is the untrained curve's value at zero (0.047); repeated rows are scored one by one;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.llm.common import hash_fraction, held_out, stored

#: Bounds of the training sample, in expectation; they bound the lexicon too.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
MIN_ROWS, MIN_SHARE, CHANCE, SHORTEST, LONGEST, SEED = 4, 0.985, 0.01, 3, 8, 23
FLUSH = 400_000

# Letters that look like Latin ones, and signs used in place of letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏԛԝᴀвкмнтαορυνικτ", "aeopcyxijsdhlqwabkmhtaopuvikt"))
INVISIBLE = "­​‌‍⁠﻿"
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "trash collection", "pathetic fallacy",
              "scum line", "pond scum", "soap scum", "sore loser", "idiot proof", "idiot light")

_FOLD = {ord(a): b for a, b in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE} \
    | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
_SIGN = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\W_]))[0134578@$](?=[^\W\d_])")
_RUN = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> list[str]:
    """The letter runs of the folded text."""
    s = (text or "").lower()
    if not s.isascii():
        s = s.translate(_FOLD)
    return _RUN.findall(_SIGN.sub(lambda m: SIGNS[m[0]], s))


def copy_mark(words: list[str]) -> int:
    """A min-hash of the word triples: near copies mostly share it."""
    if len(words) < 3:
        return zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))
    return min(zlib.crc32(f"{a} {b} {c}".encode("utf-8", "surrogatepass")) for a, b, c in zip(words, words[1:], words[2:]))


def entries_of(words) -> set[str]:
    """Candidate entries: whole words (" word ") and word beginnings (" wor")."""
    out = set()
    for w in set(words):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(model: Model):
    """Entries map to (length, weight); exception phrases to (length, None)."""
    a = ahocorasick.Automaton()
    for entry, weight in model.weights.items():
        a.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        entry = f" {' '.join(fold(phrase))} "
        a.add_word(entry, (len(entry), None))
    a.make_automaton()
    return a


def weigh(a, words: list[str]) -> tuple[float, int]:
    """Summed weight (the largest entry of each word, none under an exception phrase), number of words."""
    if not words:
        return 0.0, 0
    hay = f" {' '.join(words)} "
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(hay):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:
        # Both in order of position, so one pass: the furthest end of the phrases that began so far.
        excused.sort()
        reach, k, left = -1, 0, {}
        for s in sorted(best):
            while k < len(excused) and excused[k][0] <= s:
                reach = max(reach, excused[k][1])
                k += 1
            if s >= reach:
                left[s] = best[s]
        best = left
    return sum(best.values()), len(words)


def features(total: float, n: int) -> tuple[float, float, float]:
    """Constant, weight, and weight for each hundred words (both damped)."""
    return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / (n + 20)))


def select_entries(counts: list[tuple[str, int, int]], n1: int, n0: int, tested: int) -> dict[str, float]:
    """Weights of the entries that are toxic beyond chance: the share of toxic texts among theirs must
    exceed the sample's by a margin that one of ``tested`` entries would reach by luck with probability
    CHANCE at most (Chernoff bound, Bonferroni), and be high at equal class sizes. An entry under a chosen
    shorter one that is about as sure adds nothing and goes."""
    chosen: dict[str, tuple[float, float]] = {}
    base, need = n1 / (n1 + n0), math.log(max(tested, 1) / CHANCE)
    for entry, a, b in sorted(counts, key=lambda x: (len(x[0]), x[0])):
        share = a / (a + b)
        if a < MIN_ROWS or share <= base:
            continue
        excess = share * math.log(share / base) + (1 - share) * math.log(max(1 - share, 1e-300) / (1 - base))
        p = a / (a + b * n1 / n0)
        if (a + b) * excess < need or p < MIN_SHARE:
            continue
        if any(entry[:k] in chosen and chosen[entry[:k]][1] >= p - 0.02 for k in range(2, len(entry))):
            continue
        chosen[entry] = (math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)), p)
    return {e: chosen[e][0] for e in sorted(chosen)}


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a ridge; slopes are not negative."""
    x, y = x.astype(float), y.astype(float)
    w = np.zeros(3)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.5 * w * (0.02, 1, 1)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.diag([0.02, 1, 1])
        w = w - np.linalg.solve(hess, grad)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Mine the lexicon on one half of a bounded sample of labelled rows and fit the curve on the other."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(exceptions=exceptions)
    share = F.when(F.col("toxic"), TOXIC_ROWS / sizes[True]).otherwise(CLEAN_ROWS / sizes[False])
    sample = ids.filter(hash_fraction(F.col("doc_id"), SEED) < share) \
        .withColumn("fit", hash_fraction(F.col("doc_id"), SEED + 1) < 0.3)
    # At most about TOXIC_ROWS + CLEAN_ROWS ids by construction, so the broadcast is bounded.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [copy_mark(fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"])

    # Copies of one text would pass for independent evidence: one row of each mark and class stays.
    rows = stored(rows.mapInArrow(sketch, "doc_id long, text string, toxic boolean, fit boolean, mark long")
                  .groupBy("mark", "toxic").agg(F.min_by(F.struct("text", "fit"), "doc_id").alias("r"))
                  .select("r.text", "toxic", "r.fit"), "toxic-sample")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = (Counter(), Counter()), Counter()

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                 pa.array([seen[0][k] for k in keys], pa.int64())], names=["entry", "n1", "n0"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                kinds[toxic] += 1
                seen[toxic].update(entries_of(fold(text)))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        seen[0][""], seen[1][""] = kinds[False], kinds[True]
        yield flush()

    counts = stored(rows.filter("not fit").select("text", "toxic").mapInArrow(mine, "entry string, n1 long, n0 long")
                    .groupBy("entry").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
                    .filter(F.col("n1") >= MIN_ROWS), "lexicon")
    total = counts.groupBy((F.col("entry") == "").alias("all")).agg(
        F.count(F.lit(1)).alias("n"), F.max("n1").alias("n1"), F.max("n0").alias("n0")).collect()
    n1, n0 = next(((r["n1"], r["n0"]) for r in total if r["all"]), (0, 0))
    if not n1 or not n0:
        return Model(exceptions=exceptions)
    # Only entries that are likely enough come to the driver; a sample of bounded size has a bounded number.
    likely = counts.filter((F.col("entry") != "") & (F.col("n1") * n0 * (1 - MIN_SHARE) >= F.col("n0") * n1 * MIN_SHARE))
    weights = select_entries([(r["entry"], r["n1"], r["n0"]) for r in likely.collect()], n1, n0,
                             sum(r["n"] for r in total))
    model = Model(weights, exceptions=exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model)
        for batch in batches:
            got = [features(*weigh(a, fold(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()),
                 batch.column("toxic")], names=["a", "b", "toxic"])

    got = rows.filter("fit").select("text", "toxic").mapInArrow(measure, "a double, b double, toxic boolean").collect()
    if len({r["toxic"] for r in got}) == 2 and weights:
        x = np.array(sorted((r["a"], r["b"], r["toxic"]) for r in got), float)
        model.curve = fit_curve(np.column_stack([np.ones(len(x)), x[:, :2]]), x[:, 2])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, weight, n_words; the lexicon is bounded by the sample and goes with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = automaton(model), np.array(model.curve)
        for batch in batches:
            got = [weigh(a, fold(t)) for t in batch.column("text").to_pylist()]
            z = np.array([features(*g) for g in got]).reshape(-1, 3) @ w
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()),
                 pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                names=["doc_id", "score", "weight", "n_words"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, score double, weight double, n_words long")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, n_words of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "weight", "n_words")
