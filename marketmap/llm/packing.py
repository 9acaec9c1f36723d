"""Hierarchical multi-length packing of documents into fixed context windows.

A document is its token ids and one end id. It is routed by length to context tiers (2048, 1024, 512,
256): whole windows of the longest tier are cut off, and the rest goes to the smallest tier that holds it.
Each tier is packed: windows of the longest tier take one long rest, largest first, and their gap is
filled from the shorter tiers (the largest piece that fits, again and again; the last place by a cut of
a shorter piece); what is left in the shorter tiers fills windows of their own length, cut at the
border. At the end of a partition the remainder goes to windows of falling powers of two, so no
window needs padding. Windows of one tier, over all partitions, form step groups of STEP_TOKENS tokens each (8
windows of 2048, or 16 of 1024 ...), so every step of a tier carries the same work; only the last group of a tier may
be short.

Packing runs in each scan partition on its own, with a buffer of bounded size, so no text or ids are shuffled; a
retried task sees the same rows and gives the same windows. ``sequence_id`` holds the partition in its
high bits. The windows are written once to the shared folder; counts per partition and tier (a few numbers each) become
broadcast offsets that number the windows of a tier over all partitions.

Edge cases: null text counts as empty, an empty document is its end id alone; documents longer than any
window are cut and none is dropped; repeated rows are packed one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketmap.llm.common import stored
from marketmap.llm.tokens import worker_encoder

TIERS = (2048, 1024, 512, 256)
WINDOW = TIERS[0]
STEP_TOKENS = 8 * WINDOW
#: Rests of documents that are packed together.
BUFFER = 4096
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class Piece:
    """A run of one document's ids: ``ids`` as bytes, from ``start`` of a document of ``total`` ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:4 * n], self.total),
                Piece(self.doc, self.start + n, self.ids[4 * n:], self.total))


class Shelf:
    """Pieces of one tier, by length; the first in first out among equals."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by: dict[int, list[Piece]] = {}

    def add(self, piece: Piece) -> None:
        n = len(piece)
        if n not in self.by:
            insort(self.lengths, n)
            self.by[n] = []
        self.by[n].append(piece)

    def largest(self, limit: int) -> int:
        """Length of the largest piece of ``limit`` ids at most; 0 for none."""
        i = bisect_left(self.lengths, limit + 1)
        return self.lengths[i - 1] if i else 0

    def take(self, n: int) -> Piece:
        rows = self.by[n]
        piece = rows.pop()
        if not rows:
            del self.by[n]
            self.lengths.pop(bisect_left(self.lengths, n))
        return piece


class Packer:
    """Packs the pieces of one partition; ``out`` collects (piece, sequence, offset, tier, number of the window
    in its tier)."""

    def __init__(self, base: int):
        self.base, self.next = base, 0
        self.filled = dict.fromkeys(TIERS, 0)
        self.shelves = {t: Shelf() for t in TIERS}
        self.held = 0
        self.out: list[tuple[Piece, int, int, int, int]] = []

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % WINDOW
        for a in range(0, whole, WINDOW):
            self._close([Piece(doc, a, ids[4 * a:4 * (a + WINDOW)], total)], WINDOW)
        if whole < total:
            rest = Piece(doc, whole, ids[4 * whole:], total)
            self.shelves[min(t for t in TIERS if t >= len(rest))].add(rest)
            self.held += 1
            if self.held >= BUFFER:
                self.pack()

    def _close(self, pieces: list[Piece], tier: int) -> None:
        sequence, offset = self.base + self.next, 0
        number = self.filled.get(tier, 0)
        self.next += 1
        self.filled[tier] = number + 1
        for p in pieces:
            self.out.append((p, sequence, offset, tier, number))
            offset += len(p)

    def pack(self, last: bool = False) -> None:
        """Pack what is held; unless it is the last time, less than one window of each short tier stays."""
        long, short = self.shelves[WINDOW], TIERS[1:]
        while long.lengths:
            pieces = [long.take(long.lengths[-1])]
            gap = WINDOW - len(pieces[0])
            while gap:
                n, t = max((self.shelves[t].largest(gap), t) for t in short)
                if not n:
                    t = next((t for t in reversed(short) if self.shelves[t].lengths), None)
                    if t is None:
                        break
                    head, tail = self.shelves[t].take(self.shelves[t].lengths[0]).cut(gap)
                    self._shelve(tail)
                    pieces.append(head)
                    gap = 0
                    break
                pieces.append(self.shelves[t].take(n))
                gap -= n
            if gap:
                # The short tiers are empty: cut another long rest, or leave the window for the end.
                if not long.lengths:
                    self._finish(pieces) if last else self._hold(pieces)
                    break
                head, tail = long.take(long.lengths[0]).cut(gap)
                pieces.append(head)
                self._shelve(tail)
            self._close(pieces, WINDOW)
        left: list[Piece] = []
        for t in short:
            run, size = [], 0
            shelf = self.shelves[t]
            while shelf.lengths:
                piece = shelf.take(shelf.lengths[-1])
                while size + len(piece) >= t:
                    head, tail = piece.cut(t - size)
                    self._close([*run, head], t)
                    run, size, piece = [], 0, tail
                    if not len(piece):
                        break
                if len(piece):
                    run.append(piece)
                    size += len(piece)
            left += run
        self.held = 0
        if last:
            self._finish(left)
        else:
            self._hold(left)

    def _shelve(self, piece: Piece) -> None:
        if len(piece):
            self.shelves[min(t for t in TIERS if t >= len(piece))].add(piece)

    def _hold(self, pieces: list[Piece]) -> None:
        for p in pieces:
            self._shelve(p)
            self.held += 1

    def _finish(self, pieces: list[Piece]) -> None:
        """Windows of falling powers of two for the pieces in order."""
        size = sum(map(len, pieces))
        pieces = pieces[::-1]
        while size:
            want = min(1 << (size.bit_length() - 1), WINDOW)
            size -= want
            tier, run = want, []
            while want:
                head, tail = pieces.pop().cut(want)
                want -= len(head)
                run.append(head)
                if len(tail):
                    pieces.append(tail)
            self._close(run, tier)


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group,
    and the ids themselves on request. ``tokenizer``: path of a file whose vocabulary drops white space, or a function that
    finds it on the worker."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(found) -> pa.RecordBatch:
        cols = [pa.array([p.doc for p, *_ in found], pa.int64()), pa.array([p.start for p, *_ in found], pa.int64()),
                pa.array([len(p) for p, *_ in found], pa.int64()),
                pa.array([zlib.crc32(p.ids) for p, *_ in found], pa.int64()),
                pa.array([p.total for p, *_ in found], pa.int64())]
        cols += [pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int64()))]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if with_ids:
            cols.append(pa.array([np.frombuffer(p.ids, "<u4").astype(np.int32) for p, *_ in found], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, keeps_space=False)
        packer = Packer(TaskContext.get().partitionId() << 36)
        for batch in batches:
            texts = ((t or "") for t in batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                packer.add(doc, ids + end)
                if len(packer.out) >= 4 * BUFFER:
                    yield rows(packer.out)
                    packer.out = []
        packer.pack(last=True)
        yield rows(packer.out)

    found = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
    return _grouped(stored(found, "windows"))


def _grouped(windows: DataFrame) -> DataFrame:
    """Windows of all partitions, numbered in each tier (``step_group`` holds their number in the partition), in step
    groups."""
    part = F.shiftright("sequence_id", 36)
    before = Window.partitionBy("tier").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = windows.groupBy(part.alias("_part"), "tier").agg((F.max("step_group") + 1).alias("_n")) \
        .select("_part", F.col("tier").alias("_tier"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    step = F.floor((F.col("_first") + F.col("step_group")) * F.col("tier") / STEP_TOKENS)
    return windows.join(F.broadcast(offsets), (part == F.col("_part")) & (F.col("tier") == F.col("_tier"))) \
        .withColumn("step_group", step.cast("long")).select(windows.columns)
