"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams (1 to 4, within words, with word
boundaries), each hashed to one of BUCKETS rows; a linear softmax over the average gives the language.
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled rows. A part of the sample that training does not see calibrates the temperature of the
softmax and the rejection threshold: the confidence below which only REJECT_SHARE of known-language
texts fall.

Only text and a non-null lang of rows outside the held-out fold are learned from; a prediction sees the
text alone. For the prediction the two linear layers are one table (bucket x language), so each n-gram
is one lookup; texts of any length are processed whole, in pieces.

Edge cases: null text or a text without a letter gives ``und`` with score 0 and is rejected; ties go to
the language that sorts first; repeated rows are scored one by one; with no labelled row at all every text
is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.llm.common import hash_fraction, held_out

BUCKETS, DIM, MAX_N = 1 << 15, 16, 4
#: Bounds of the training sample: labelled rows for each language (in expectation), and languages.
ROWS_PER_LANGUAGE, MAX_LANGUAGES = 500, 1000
CALIBRATION_SHARE, REJECT_SHARE, EPOCHS, RATE, SEED = 0.2, 0.002, 6, 0.5, 17
PIECE = 1 << 20


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray       # BUCKETS x languages, float32: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float        # texts of a lower score are rejected


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(codes: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of the n-grams that begin in the first ``first`` places of ``codes``, where 0
    is a word boundary; no n-gram has a boundary inside."""
    c = np.append(codes, np.zeros(MAX_N, np.uint32))
    at = np.arange(min(first, len(codes)))
    h = np.zeros(len(at), np.uint32)
    inside = np.ones(len(at), bool)
    for n in range(1, MAX_N + 1):
        x = c[n - 1:n - 1 + len(at)]
        h = (h ^ x) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        keep = (x != 0) if n == 1 else inside & ((x != 0) | (c[:len(at)] != 0))
        yield at[keep], (h[keep] >> np.uint32(7)) & np.uint32(BUCKETS - 1)
        if n > 1:
            inside &= x != 0


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(0))


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts' characters in runs of about PIECE: (codes, row of each place, places to count)."""
    codes, owner, size = [], [], 0
    for row, text in enumerate(texts):
        c = _codes(text or "")
        if len(c) > PIECE:
            c = np.append(np.uint32(0), c)  # the boundary before the first word
        for a in range(0, len(c), PIECE):
            part = c[a:a + PIECE + MAX_N]
            if len(c) > PIECE:
                yield part, np.full(len(part), row), PIECE
            else:
                codes += [np.zeros(MAX_N, np.uint32), part]
                owner += [np.full(MAX_N, row), np.full(len(part), row)]
                size += len(part)
        if size >= PIECE:
            yield np.concatenate(codes), np.concatenate(owner), size + MAX_N * len(texts)
            codes, owner, size = [], [], 0
    if codes:
        c = np.concatenate(codes)
        yield c, np.concatenate(owner), len(c)


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, count) of each text's n-grams."""
    out = []
    for text in texts:
        total = np.zeros(BUCKETS, np.int64)
        for codes, _, first in _pieces([text]):
            for _, bucket in _grams(codes, first):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        out.append((at, total[at]))
    return out


def logits(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Average of the looked-up rows plus bias, and the number of n-grams, of each text."""
    sums = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts), np.int64)
    for codes, owner, first in _pieces(texts):
        for at, bucket in _grams(codes, first):
            rows = owner[at]
            if len(rows):
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                sums[rows[starts]] += np.add.reduceat(model.table[bucket], starts, axis=0, dtype=np.float64)
                n[rows[starts]] += np.diff(np.append(starts, len(rows)))
    return sums / np.maximum(n, 1)[:, None] + model.bias, n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]]) -> Model:
    """``rows``: (language, for calibration, buckets, counts). Plain SGD, one row at a time, fixed order."""
    rows = [r for r in rows if len(r[2])]
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    index = {lang: i for i, lang in enumerate(languages)}
    train = [r for r in rows if not r[1]] or rows
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            lang, _, bucket, count = train[i]
            share = (count / count.sum()).astype(np.float32)
            x = share @ emb[bucket]
            g = softmax(x @ out + bias)
            g[index[lang]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= rate * np.float32(0.1) * g
            # The rows of a text share one gradient; scaled by the text's size in buckets, as each is seen rarely.
            emb[bucket] -= rate * np.minimum(share[:, None] * np.float32(50), 1) * back
            done += 1
    model = Model(languages, emb @ out, bias, 1.0, 0.0)
    known = [r for r in rows if r[1]] or rows
    if not known:
        return model
    z = np.array([(c / c.sum()) @ model.table[b] + bias for _, _, b, c in known])
    y = np.array([index[r[0]] for r in known])
    grid = np.geomspace(0.05, 20, 60)
    nll = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(nll))])
    right = softmax(z / model.temperature)
    right = right.max(axis=1)[right.argmax(axis=1) == y]
    if len(right):
        model.threshold = float(min(np.quantile(right, REJECT_SHARE), 0.5))
    return model


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample: about ROWS_PER_LANGUAGE labelled rows of each language, by a hash of doc_id.

    Of more than MAX_LANGUAGES labels, those with most labelled rows are learned (ties: in order of name); texts of
    the others are predicted or rejected by what was learned."""
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                                                            & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return fit([])
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], ROWS_PER_LANGUAGE / r["count"])))
    sample = labelled.filter(hash_fraction(F.col("doc_id"), SEED) < shares[F.col("lang")]) \
        .select("doc_id", "text", "lang", (hash_fraction(F.col("doc_id"), SEED + 1) < CALIBRATION_SHARE).alias("cal"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("cal"),
                 pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "cal", "bucket", "n"])

    got = sample.mapInArrow(featurise, "doc_id long, lang string, cal boolean, bucket array<int>, n array<int>") \
        .toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    cols = [got.column(c) for c in ("lang", "cal", "bucket", "n")]
    return fit([(lang.as_py(), cal.as_py(), b.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64))
                for lang, cal, b, n in zip(*cols)])


def _scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability (0 without a letter) and the number of n-grams of each text."""
    if not model.languages or not texts:
        return np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int)
    z, n = logits(model, texts)
    p = softmax(z / model.temperature)
    return p.argmax(axis=1), np.where(n > 0, p.max(axis=1), 0.0), n


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected; the model is a fixed-size table that goes with the function."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, top, n = _scores(model, batch.column("text").to_pylist())
            names = [model.languages[b] if k else "und" for b, k in zip(best, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(top, pa.float64()),
                 pa.array((n == 0) | (top < model.threshold), pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        score, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of ``docs`` (with a text column) that are not rejected."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, top, n = _scores(model, batch.column("text").to_pylist())
            yield batch.filter(pa.array((n > 0) & (top >= model.threshold), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                                             "lang_pred", "score", "rejected")
