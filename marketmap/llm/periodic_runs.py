"""Periodic runs of words: scale-tiled detection, stitched by (document, period).

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least SHORTEST words and
TIMES periods.

1. Tiles. Periods fall into octaves: [1, 8), then [P, 2P) for P = 8, 16, ... For an octave, a document is cut
   into blocks of P words (8 in the first). A run of one of its periods q repeats, q words on, on 2P - 1 places or
   more, so on a whole block. Each block gives an overlapping tile: P words before it, 4P from its start. Tiles of
   blocks that no period of the octave can repeat are left out; rolling hashes of all blocks against all places one
   to two blocks on tell which (equal words have equal hashes, so none is lost; the rest is decided by words).
2. Tiles are solved on their own, by two Z-functions at the boundary where the block starts: how far the words after it
   equal those q on (forwards), and those before it (backwards). A period whose block is whole gives a fragment: the
   places i of the tile with word i = word i + q around the boundary. A period that is a multiple of a shorter
   one there is so in the whole run (its words from the boundary on hold one and a half periods) and is dropped.
   Fragments that end inside the tile on both sides and are too short go as well.
3. Fragments of neighbouring tiles overlap. They are shuffled by (document, period) and stitched with a window function; a
   stitched stretch that is long enough is a run. A run's fragments number about its length over its period.

Documents without a tile (most) are finished in the first pass; the texts of the others are written beside their
fragments and meet their runs in a join on a unique row number, so repeated doc_ids stay apart and no group holds
more than a document.

Words are ``[^\\x20\\x09-\\x0D]+``. A word is dropped from the collapsed text if a run contains it after its first q
words. Edge cases: null, empty and blank texts have no words, no run and an empty collapsed text; ties of the best run go
to the smallest start, then the smallest period; repeated rows are solved one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmap.llm.common import stored

SHORTEST, TIMES, FIRST = 24, 3, 8
#: Rows that leave a task together, and bytes of their tiles.
BATCH_ROWS, BATCH_BYTES = 2048, 1 << 22
_BASE = 0x9E3779B97F4A7C15
TILES = "row long, doc_id long, text binary, collapsed string, octave int, start long, before int, n long, words binary"
SOLVED = "row long, doc_id long, text binary, collapsed string, period int, lo long, hi long"
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i < size."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def numbered(words: list) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(block, first period, last period + 1) of the octaves that a text of n words can hold runs of."""
    if n >= SHORTEST:
        yield FIRST, 1, FIRST
        block = FIRST
        while TIMES * block <= n:
            yield block, block, 2 * block
            block *= 2


def promising_blocks(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, first period, starts) of the blocks that some period of the octave seems to repeat."""
    n = len(ids)
    power, inverse = _powers(max(1 << 16, 1 << n.bit_length()))
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=total[1:])
    hashes, size = None, 0
    for block, first, _ in octaves(n):
        if size != block:
            hashes, size = (total[block:] - total[:-block]) * inverse[:n - block + 1], block
        # Row j: the hashes at the places that the octave's periods lead to from the block's start.
        shift = block if first == block else 0
        rows = max(0, -(-(len(hashes) - shift) // block))
        if not rows:
            continue
        ahead = np.zeros(rows * block, np.uint64)
        ahead[:len(hashes) - shift] = hashes[shift:]
        own = hashes[:rows * block:block]
        same = ahead.reshape(rows, block) == own[:rows, None]
        if first == 1:
            same[:, 0] = False
        filled = len(hashes) - shift - (rows - 1) * block
        same[-1, filled:] = False
        starts = np.flatnonzero(same.any(axis=1)) * block
        if len(starts):
            yield block, first, starts


def z_function(s: list[int], count: int) -> list[int]:
    """z[i]: how many numbers from i on equal those from 0 on, for 0 < i < count (z[0] is the whole length)."""
    n = len(s)
    z = [0] * min(count, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def shorter_periods(q: int) -> tuple[int, ...]:
    """q over each of its prime divisors."""
    out, rest, d = [], q, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    if rest > 1:
        out.append(q // rest)
    return tuple(out)


def solve_tile(words: list[int], before: int, first: int, block: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, lo, hi) of a tile whose block starts at word ``start`` of n, with ``before`` words ahead of it: word i
    equals word i + period for lo <= i < hi."""
    right = words[before:]
    reach = min(2 * block, len(right))
    ahead = z_function(right, 2 * block)
    last = block if first == 1 else 2 * block
    found = [q for q in range(first, min(last, len(ahead))) if ahead[q] >= block
             and not any(ahead[g] >= q for g in shorter_periods(q))]
    if not found:
        return
    back = words[:before][::-1]
    behind = z_function([*back, -1, *words[:before + reach][::-1]], before + 1 + reach)
    for q in found:
        b, f = behind[before + 1 + reach - q], min(ahead[q], 2 * block)
        open_left = b == before and before < start
        open_right = ahead[q] >= 2 * block and start + f + q < n
        if open_left or open_right or b + f + q >= max(SHORTEST, TIMES * q):
            yield q, start - b, start + f


def _explode(docs: DataFrame) -> DataFrame:
    """A row for each document (octave null; its text where it has tiles, else its collapsed digest) and each tile."""
    names = [c.split()[0] for c in TILES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        out, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").split()  # bytes split at the six ASCII white-space signs alone
                n, tiled = len(words), False
                row += 1
                if n >= SHORTEST:
                    ids = numbered(words)
                    for block, first, starts in promising_blocks(ids):
                        tiled = True
                        for start in starts.tolist():
                            before = min(block, start)
                            tile = ids[start - before:start + 4 * block].tobytes()
                            out.append((row, None, None, None, first, start, before, n, tile))
                            size += len(tile)
                            if size >= BATCH_BYTES:
                                yield _batch(out, names, types)
                                out, size = [], 0
                mine = b" ".join(words)
                out.append((row, doc, mine if tiled else None, None if tiled else hashlib.sha256(mine).hexdigest(), *(None,) * 5))
                size += len(mine) if tiled else 0
                if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(out, names, types)
                    out, size = [], 0
        if out:
            yield _batch(out, names, types)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, TILES)


def _batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _solve(tiles: DataFrame) -> DataFrame:
    """Document rows as they are, and a row for each fragment of a tile."""
    names = [c.split()[0] for c in SOLVED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.is_null(batch.column("octave"))
            heads, tiles_of = batch.filter(whole), batch.filter(pc.invert(whole))
            empty = [pa.nulls(heads.num_rows, t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([*heads.select(names[:4]).columns, *empty], names=names)
            out = []
            for row, first, start, before, n, words in zip(*(tiles_of.column(c).to_pylist()
                                                             for c in ("row", "octave", "start", "before", "n", "words"))):
                ids = np.frombuffer(words, "<i4").tolist()
                out += [(row, None, None, None, *f) for f in solve_tile(ids, before, first, max(first, FIRST), start, n)]
            if out:
                yield _batch(out, names, types)

    return tiles.mapInArrow(run, SOLVED)


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (row, start, length, period) of fragments (row, period, lo, hi): overlapping ones of one document and period are
    joined."""
    order = Window.partitionBy("row", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(F.col("lo") <= reached, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(order)) \
        .groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    return islands.select("row", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"),
                          F.col("period").cast("long").alias("period")) \
        .filter((F.col("length") >= SHORTEST) & (F.col("length") >= TIMES * F.col("period")))


def run_digests(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of runs (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    collapsed = hashlib.sha256(b" ".join([words[i] for i in kept.tolist()])).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), collapsed)


def _collapse(docs: DataFrame) -> DataFrame:
    """Results of the documents with tiles, from (doc_id, text, runs)."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                found = [(r["start"], r["length"], r["period"]) for r in runs or ()]
                out.append((doc, *run_digests(text.split(b" ") if text else [], found)))
            yield _batch(out, names, types)

    return docs.mapInArrow(run, RESULT)


def solved_documents(docs: DataFrame) -> DataFrame:
    """Document rows and fragment rows, written once."""
    return stored(_solve(_explode(docs)), "run-fragments")


def runs_of(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run."""
    solved = solved_documents(docs)
    heads = solved.filter("period is null and text is not null").select("row", "doc_id")
    return stitched(solved.filter("period is not null").select("row", "period", "lo", "hi")).join(heads, "row") \
        .select("doc_id", "start", "length", "period")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    solved = solved_documents(docs)
    runs = stitched(solved.filter("period is not null").select("row", "period", "lo", "hi")) \
        .groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    heads = solved.filter("period is null")
    tiled = heads.filter("text is not null").select("row", "doc_id", "text").join(runs, "row", "left")
    none = F.lit(None).cast("long")
    plain = heads.filter("text is null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"))
    return plain.unionByName(_collapse(tiled.select("doc_id", "text", "runs")))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a hash of the id, the words from one on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h")) \
        .withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    start = hashed.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int")) \
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    place = F.sequence(F.lit(0), F.col("n") - 1)

    def word(i):
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))

    return start.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform(place, word), " "))
                        .otherwise(F.col("text")).alias("text"))
