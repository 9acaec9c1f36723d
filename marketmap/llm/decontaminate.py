"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max pruning.

Every passage of every document (windows of two longest-item lengths, one length apart, so a run of words
as long as any item lies whole in one of them) is a query against an index of the benchmark items; all items
whose score reaches their threshold are retrieved and verified on 5-word shingles.

Scores are BM25 impacts relative to the item's own full score, so 1 means that all its words occur. The
threshold of an item is the least score that a passage can have that holds 80 percent of its shingles:
each missing shingle takes away one word at most, so what the heaviest words for the allowed number of
missing shingles are worth may be missing. Retrieval at this threshold loses no verified item.

Pruning (WAND with block maxima): items are indexed in blocks of BLOCK. Only the rarest words of an item are
essential: those beyond which the rest is worth less than half the threshold, so that a passage needs
some of them. The essential postings of a word carry the largest impact in each block; a passage and block
whose summed maxima and the block's largest rest stay under the block's lowest threshold are
skipped, and only the others are scored in full.

An item is split into question and answer (a line that starts with ``A:`` or ``Answer:``; else the last
line, else the last sentence); the overlap of each is reported. A document is contaminated when a
passage holds at least 80 percent of all 5-word shingles of an item, question and answer together.

The index is broadcast in shards of at most SHARD_CHARS characters of items; a larger benchmark is searched
shard by shard, each with its own statistics (the verified result does not depend on them).

Edge cases: null or empty texts and texts without a word hold nothing; items without a word match nothing;
an item of fewer than 5 words is one shingle; items with the same text are all reported; repeated rows
are judged one by one; empty tables give clean or empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SHINGLE, PERCENT, BLOCK, SHARD_CHARS = 5, 80, 8, 16_000_000
_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"^\s*(?:A|Answer)\s*:", re.IGNORECASE | re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    text = text.strip()
    if m := _ANSWER.search(text):
        return text[:m.start()], text[m.end():]
    head, gap, tail = text.rpartition("\n")
    if not gap:
        parts = _SENTENCE.split(text)
        head, tail = " ".join(parts[:-1]), parts[-1]
    return (head, tail) if head else (tail, "")


def shingles(ids) -> set[tuple]:
    k = min(SHINGLE, len(ids))
    return {tuple(ids[i:i + k]) for i in range(len(ids) - k + 1)} if k else set()


class Index:
    """Inverted index of one shard of items; plain arrays, so that it is cheap to ship."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, t, w) for i, t in sorted(items) if (w := words(t))]
        self.item_ids = [i for i, _, _ in items]
        self.terms: dict[str, int] = {}
        for _, _, w in items:
            for x in w:
                self.terms.setdefault(x, len(self.terms))
        self.longest = max((len(w) for _, _, w in items), default=1)
        sequences = [[self.terms[x] for x in w] for _, _, w in items]
        self.shingles = [shingles(s) for s in sequences]
        self.parts = [tuple(shingles([self.terms.get(x, -1) for x in words(p)]) for p in split_item(t)) for _, t, _ in items]
        df = Counter(x for s in sequences for x in set(s))
        n, mean = len(items), sum(map(len, sequences)) / max(len(items), 1)
        # Postings by item: terms and relative impacts; the threshold; the essential terms and the rest's worth.
        self.postings, self.threshold = [], np.zeros(n)
        rest = np.zeros(n)
        essential: list[tuple[int, int, float]] = []
        for k, s in enumerate(sequences):
            tf = Counter(s)
            t = np.array(sorted(tf), np.int64)
            f, d = np.array([tf[x] for x in t], float), np.array([df[x] for x in t], float)
            impact = np.log1p((n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(s) / mean))
            impact /= impact.sum()
            self.postings.append((t, impact))
            missing = len(self.shingles[k]) * (100 - PERCENT) // 100
            self.threshold[k] = 1 - np.sort(impact)[::-1][:missing].sum() - 1e-9
            order = np.argsort(d, kind="stable")
            left = 1 - np.cumsum(impact[order])
            # Without a positive threshold any word may be missing, so all are essential.
            need = int(np.argmax(left < self.threshold[k] / 2)) + 1 if self.threshold[k] > 0 else len(order)
            rest[k] = left[need - 1]
            essential += [(int(t[j]), k // BLOCK, float(impact[j])) for j in order[:need]]
        self.blocks = -(-n // BLOCK)
        pad = self.blocks * BLOCK - n
        self.block_rest = np.append(rest, np.zeros(pad)).reshape(-1, BLOCK).max(axis=1) if n else rest
        self.block_threshold = np.append(self.threshold, np.full(pad, 9.0)).reshape(-1, BLOCK).min(axis=1) if n else rest
        # Block maxima of the essential postings, by term.
        best: dict[tuple[int, int], float] = {}
        for t, block, x in essential:
            best[t, block] = max(best.get((t, block), 0.0), x)
        keys = sorted(best)
        self.max_block = np.array([b for _, b in keys], np.int64)
        self.max_impact = np.array([best[k] for k in keys])
        self.first = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(self.terms) + 1))

    def encode(self, text: str | None) -> np.ndarray:
        found = words(text)
        get = self.terms.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def open_blocks(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, passage, block) that the bounds do not exclude. Passage p is cells p and p + 1; a
        cell is a run of ``longest`` words."""
        sizes = [-(-len(d) // self.longest) + 1 for d in docs]
        first = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        cell = np.concatenate([first[k] + np.arange(len(d)) // self.longest for k, d in enumerate(docs)]) if docs else ids
        known = np.flatnonzero(ids >= 0)
        n = self.first[ids[known] + 1] - self.first[ids[known]]
        known, n = known[n > 0], n[n > 0]
        if not len(known):
            return []
        at = np.repeat(self.first[ids[known]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key = np.repeat(cell[known], n) * self.blocks + self.max_block[at]
        keys, place = np.unique(key, return_inverse=True)
        total = np.bincount(place, self.max_impact[at])
        # Bound of a passage: its cell and the next one (documents end with an empty cell).
        after = np.searchsorted(keys, keys + self.blocks)
        after = np.minimum(after, len(keys) - 1)
        both = total + np.where(keys[after] == keys + self.blocks, total[after], 0)
        # A passage whose first cell has nothing in the block is covered by the passage after it.
        block = keys % self.blocks
        keep = both + self.block_rest[block] >= self.block_threshold[block]
        cells = keys[keep] // self.blocks
        doc = np.searchsorted(first, cells, side="right") - 1
        return list(zip(doc.tolist(), (cells - first[doc]).tolist(), block[keep].tolist()))

    def search(self, docs: list[np.ndarray]) -> list[list[tuple[int, float, float, float, float]]]:
        """For each document (item, score, overlap, question overlap, answer overlap) of its verified items."""
        out: list[dict[int, tuple]] = [{} for _ in docs]
        for doc, passage, block in self.open_blocks(docs):
            # One cell back as well: the run may begin there with words that are not essential.
            a = max(0, passage - 1) * self.longest
            window = docs[doc][a:(passage + 2) * self.longest]
            present = np.unique(window)
            held = None
            for k in range(block * BLOCK, min((block + 1) * BLOCK, len(self.item_ids))):
                t, impact = self.postings[k]
                score = float(impact[np.isin(t, present, assume_unique=True)].sum())
                if score < self.threshold[k]:
                    continue
                if held is None:
                    held = window.tolist()
                grams = shingles_of_length(held, min(SHINGLE, len(next(iter(self.shingles[k])))))
                hit = len(self.shingles[k] & grams)
                if 100 * hit >= PERCENT * len(self.shingles[k]):
                    parts = [len(p & shingles_of_length(held, len(next(iter(p))))) / len(p) if p else 0.0 for p in self.parts[k]]
                    row = (self.item_ids[k], score, hit / len(self.shingles[k]), *parts)
                    out[doc][k] = max(out[doc].get(k, row), row)
        return [[o[k] for k in sorted(o)] for o in out]


def shingles_of_length(ids: list[int], k: int) -> set[tuple]:
    return {tuple(ids[i:i + k]) for i in range(len(ids) - k + 1)}


FOUND = ("__bench_items array<long>, __bench_bm25 double, __bench_overlap double, __bench_question double, "
         "__bench_answer double")
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _shards(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in shards of bounded size, by a hash of the id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text") \
        .filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // SHARD_CHARS))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _merge(index: Index, batch: pa.RecordBatch) -> list[pa.Array]:
    """The found columns of a batch with what this shard adds."""
    texts = batch.column("text").to_pylist()
    found: list = []
    a = 0
    while a < len(texts):  # about a megabyte at once
        b, size = a, 0
        while b < len(texts) and size < 1 << 20:
            size += len(texts[b] or "")
            b += 1
        found += index.search([index.encode(t) for t in texts[a:b]])
        a = b
    before = zip(*(batch.column(c).to_pylist() for c in _NAMES))
    rows = []
    for (items, *best), own in zip(before, found):
        best = max([tuple(best), *(r[1:] for r in own)])
        rows.append((sorted(set(items) | {r[0] for r in own}), *best))
    types = [pa.list_(pa.int64())] + [pa.float64()] * 4
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]


def search_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with a text column) and, for each row, the verified items and the scores of the best. Narrow: one pass
    over the rows, shard after shard of the benchmark."""
    rows = docs.withColumns({"__bench_items": F.array().cast("array<long>"), **{c: F.lit(0.0) for c in _NAMES[1:]}})
    for items in _shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [batch.column(i) for i in range(batch.num_columns - len(_NAMES))]
                yield pa.RecordBatch.from_arrays([*kept, *_merge(shared.value, batch)], names=batch.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (sorted), and the scores of the item
    with the highest: bm25, overlap, question_overlap, answer_overlap (0 where there is none)."""
    found = search_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select("doc_id", (F.size("__bench_items") > 0).alias("contaminated"),
                        F.size("__bench_items").cast("long").alias("n_items"), F.col("__bench_items").alias("item_ids"),
                        *(F.col(c).alias(n) for c, n in zip(_NAMES[1:], ("bm25", "overlap", "question_overlap",
                                                                          "answer_overlap"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` without the contaminated rows."""
    return search_documents(docs, benchmark).filter(F.size("__bench_items") == 0).select(*docs.columns)
