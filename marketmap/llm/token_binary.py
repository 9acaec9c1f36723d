"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

The ids of all documents (each followed by an end id), in ascending doc_id order, are cut into blocks of
BLOCK_IDS ids. A block is coded on its own, with a model that starts empty, and carries a checksum, so blocks
are read in any order and a damaged one is found. Three orders predict an id as a whole: order 2 (hashed) and
order 1 each foretell the id that last followed the two ids or the one before, with a trust that grows as it comes
true, and order 0 has adaptive frequencies of all ids. They are mixed by shares that follow how often, at this pair of trusts,
order 2 was right, only order 1 was, or neither; in order 0's share an id takes its part by frequency, and ids not
seen yet share one part and add 16 plain bits. An id is so one interval (and one step) of a 64-bit carry-less range
coder that puts out 16 bits at a time. All arithmetic is on integers, so reading repeats writing exactly. A block is
cut into lanes of LANE_IDS ids that are coded in step, one numpy operation for all, and teach one model together:
the tables learn after each step, the shares every 8 steps, the frequencies each time they have grown by half.

File format: Parquet files of block rows; ``part`` is the range of doc_id, ``block`` counts in it, ``position`` is that
of the block's first id in the part, ``payload`` the coded block:

    "MMB2", number of ids (u32), crc32 of the ids as little-endian u32 (u32), 16-bit words (little-endian): three
    of each lane, then one for each time a lane takes one in, in the order of reading

and ``docs`` the documents it holds: (doc_no in the part, doc_id, number of ids in this block).

Edge cases: null text counts as empty, an empty document is its end id alone; rows that share a doc_id are
documents of their own, in any order; null ids come first; ids must be under 65,536; an empty table gives
no files' rows and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketmap.llm.common import scratch
from marketmap.llm.tokens import worker_encoder

BLOCK_IDS, LANE_IDS = 1 << 20, 256
END_ID, MAGIC = 0, b"MMB2"
BLOCK_SCHEMA = ("part int, block int, position long, n_ids int, payload binary, "
                "docs array<struct<doc_no: long, doc_id: long, n: int>>")
#: Bits of the share of a way, of an order-0 interval and of both; of the place in the order-2 table; its states.
_WAY_BITS, _ID_BITS, _TOTAL_BITS, _HASH_BITS, _STATES = 12, 17, 29, 18, 512
_FLOOR = np.uint64(1 << 36)
#: Trust in a foretold id, shifted by 16, after a miss and after a hit, from that before; from 1 on a miss replaces the id.
_TRUST = np.array([(max(t >> 1, 1), min(t + 1, 15)) for t in range(16)], np.int32).reshape(-1) << 16


class _Model:
    """What one block's lanes have learned together: the id that each context was last followed by, the shares of the
    three ways and the frequencies of ids."""

    def __init__(self) -> None:
        self.after1, self.after2 = np.zeros(1 << 16, np.int32), np.zeros(1 << _HASH_BITS, np.int32)
        self.ways = np.tile(np.array([2, 1, 2], np.int64), (_STATES, 1))  # of a state: order 2 was right, order 1 was, neither
        self.seen, self.escaped, self.n_seen = np.zeros(1 << 16, np.int64), 0, 0
        self.known = np.zeros(0, np.int64)
        self.fresh: list[np.ndarray] = []       # what is not counted yet: ids of order 0, and states with their ways
        self.fresh_ways: list[np.ndarray] = []
        self.n_fresh = self.turns = 0
        self._share()
        self._order0()

    def _share(self) -> None:
        """Shares of orders 2 and 1 in units of 1 / 2 ** _WAY_BITS, by state; something is always left for order 0."""
        if self.fresh_ways:
            self.ways += np.bincount(np.concatenate(self.fresh_ways), minlength=3 * _STATES).reshape(-1, 3)
            self.fresh_ways = []
        total = self.ways.sum(axis=1)
        self.share2 = 1 + self.ways[:, 0] * ((1 << _WAY_BITS) - 6) // total
        self.share12 = 1 + self.share2 + self.ways[:, 1] * ((1 << _WAY_BITS) - 6) // total

    def _order0(self) -> None:
        """Intervals of the ids seen, by their counts, in [0, 2 ** _ID_BITS); what is left at the end is for all others."""
        if self.n_fresh:
            new = np.bincount(np.concatenate(self.fresh), minlength=1 << 16)
            escaped = self.n_fresh - int(new[self.known].sum())
            self.seen += new
            self.n_seen += self.n_fresh
            self.escaped = escaped * self.n_seen // (2 * self.n_fresh)
            self.fresh, self.n_fresh = [], 0
        self.known = known = np.flatnonzero(self.seen)
        ends = np.cumsum(self.seen[known])
        ends *= (1 << _ID_BITS) - len(known) - 1
        ends //= self.n_seen + self.escaped + 1
        ends += np.arange(1, len(known) + 1)
        self.rest0 = int(ends[-1]) if len(known) else 0
        self.sizes = np.diff(ends, prepend=0)
        # First number and size of the interval of each id, as one number.
        self.part0 = np.full(1 << 16, self.rest0 << 32 | (1 << _ID_BITS) - self.rest0)
        self.part0[known] = (ends - self.sizes) << 32 | self.sizes
        self.slots: np.ndarray | None = None

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds ``place``, -1 beyond those of the ids seen."""
        if self.slots is None:
            self.slots = np.full(1 << _ID_BITS, -1, np.int32)
            self.slots[:self.rest0] = np.repeat(self.known.astype(np.int32), self.sizes)
        return self.slots.take(place)

    def predict(self, before: np.ndarray, before2: np.ndarray) -> None:
        """Predictions and shares for the next id of each lane, from the two before it."""
        self.at1 = before
        self.at2 = before << 16
        self.at2 |= before2
        self.at2 *= 0x1E3779B97F4A7C15
        self.at2 >>= 63 - _HASH_BITS
        self.at2 &= (1 << _HASH_BITS) - 1
        entry1, entry2 = self.after1.take(before), self.after2.take(self.at2)
        self.id1, self.id2 = entry1 & 0xFFFF, entry2 & 0xFFFF
        self.trust1, self.trust2 = entry1 >> 16, entry2 >> 16
        state = self.trust2 << 4
        state += self.trust1
        state <<= 1
        state += self.id1 == self.id2
        self.state = state.astype(np.int64)
        self.w2, self.w12 = self.share2.take(self.state), self.share12.take(self.state)

    def way_of(self, ids: np.ndarray) -> np.ndarray:
        """0 where order 2 foretold the id, 1 where only order 1 did, else 2."""
        last = ids.astype(np.int32)
        way = (self.id1 != last).astype(np.int64)
        way += 1
        way[np.flatnonzero(self.id2 == last)] = 0
        return way

    def interval(self, ids: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First number and size of the interval of each id in [0, 2 ** _TOTAL_BITS)."""
        part = self.part0.take(ids)
        size = (1 << _WAY_BITS) - self.w12
        low = part >> 32
        low *= size
        low += self.w12 << _ID_BITS
        part &= (1 << 32) - 1
        size *= part
        one = np.flatnonzero(way < 2)
        w2, second = self.w2.take(one), way.take(one)  # way 1 begins where order 2 ends
        low[one] = (w2 * second) << _ID_BITS
        w12 = self.w12.take(one)
        w12 -= w2
        size[one] = np.where(second > 0, w12, w2) << _ID_BITS
        return low.view(np.uint64), size.view(np.uint64)

    def learn(self, ids: np.ndarray, way: np.ndarray) -> None:
        last = ids.astype(np.int32)
        for table, at, trust, foretold in ((self.after1, self.at1, self.trust1, self.id1), (self.after2, self.at2, self.trust2, self.id2)):
            entry = np.where(trust > 1, foretold, last)
            trust += trust
            trust += foretold == last
            entry |= _TRUST.take(trust)
            table[at] = entry
        self.state *= 3
        self.state += way
        self.fresh_ways.append(self.state)
        missed = ids.take(np.flatnonzero(way == 2))
        self.fresh.append(missed)
        self.n_fresh += len(missed)
        self.turns += 1
        if self.turns & 7 == 0 or self.turns < 16:
            self._share()
        if self.n_fresh > 64 and 2 * self.n_fresh > self.n_seen:
            self._order0()


def _renew(low: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lanes that give out (or take in) a word, and the words given out, until every range is large."""
    small = np.flatnonzero(size < _FLOOR)
    a, s = low.take(small), size.take(small)
    while len(small):
        # The interval may cross a border of the leading word: keep the part up to the border.
        ends = s - np.uint64(1)
        ends += a
        ends ^= a
        if ends.max() >> np.uint64(48):
            s = np.where(ends >> np.uint64(48) > 0, (~a + np.uint64(1)) & np.uint64((1 << 48) - 1), s)
        yield small, a >> np.uint64(48)
        a <<= np.uint64(16)
        s <<= np.uint64(16)
        low[small], size[small] = a, s
        again = np.flatnonzero(s < _FLOOR)
        small, a, s = small.take(again), a.take(again), s.take(again)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and the ids of each; the last one may be shorter."""
    return -(-n // LANE_IDS), min(n, LANE_IDS)


def encode_block(block: np.ndarray) -> bytes:
    """Payload of a block of ids."""
    if block.max(initial=0) >= 1 << 16:
        raise ValueError("ids must be under 65,536")
    head = MAGIC + struct.pack("<II", len(block), zlib.crc32(block.astype("<u4").tobytes()))
    if not len(block):
        return head
    lanes, steps = _lanes(len(block))
    ids = np.zeros((lanes, steps), np.int64)
    ids.reshape(-1)[:len(block)] = block
    ids = np.concatenate((np.zeros((2, lanes), np.int64), ids.T))  # two zero rows stand before the first id
    shorter = lanes * steps - len(block)
    model = _Model()
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    moved: list[np.ndarray] = []   # lanes that gave out a word, in order, and the words
    words: list[np.ndarray] = []

    def renew(l: np.ndarray, s: np.ndarray, of: np.ndarray | None = None) -> None:
        for small, out in _renew(l, s):
            moved.append(small if of is None else of[small])
            words.append(out.astype(np.uint16))

    for t in range(steps):
        live = lanes - (t >= steps - shorter)
        now, l, s = ids[t + 2, :live], low[:live], size[:live]
        model.predict(ids[t + 1, :live], ids[t, :live])
        way = model.way_of(now)
        first, width = model.interval(now, way)
        escaped = np.flatnonzero(way == 2)
        escaped = escaped[model.seen.take(now.take(escaped)) == 0]
        s >>= np.uint64(_TOTAL_BITS)
        l += s * first
        s *= width
        renew(l, s)
        if len(escaped):
            el, es = l[escaped], s[escaped] >> np.uint64(16)
            el += es * now[escaped].view(np.uint64)
            renew(el, es, escaped)
            l[escaped], s[escaped] = el, es
        model.learn(now, way)
    return head + _arranged(lanes, moved, words, low).astype("<u2").tobytes()


def _arranged(lanes: int, moved: list[np.ndarray], words: list[np.ndarray], low: np.ndarray) -> np.ndarray:
    """Words in the order in which reading wants them: three of each lane (the first of all is zero), and at each
    move the one three places on."""
    lane = np.concatenate([*moved, np.zeros(0, np.int64)]).astype(np.uint16 if lanes <= 1 << 16 else np.int64)
    order = np.argsort(lane, kind="stable")
    count = np.bincount(lane, minlength=lanes)
    starts = np.cumsum(count + 4) - count - 4
    by_lane = np.zeros(len(lane) + 4 * lanes, np.uint16)
    place = np.arange(len(lane)) + 4 * lane[order].astype(np.int64)
    by_lane[place] = np.concatenate([*words, np.zeros(0, np.uint16)])[order]
    for k in range(4):
        by_lane[starts + count + k] = (low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)
    out = np.zeros(len(lane), np.uint16)
    out[order] = by_lane[place + 4]
    return np.concatenate([by_lane[starts + k] for k in (1, 2, 3)] + [out])


def decode_block(payload: bytes) -> np.ndarray:
    """Ids of a payload; a wrong checksum raises ValueError."""
    magic, (n, check) = payload[:4], struct.unpack("<II", payload[4:12])
    lanes, steps = _lanes(n)
    words = np.frombuffer(payload, "<u2", offset=12).astype(np.uint64)
    damaged = ValueError("a block does not match its checksum")
    if magic != MAGIC or len(words) < 3 * lanes:
        raise damaged
    code, at = np.zeros(lanes, np.uint64), 0
    for _ in range(3):
        code = code << np.uint64(16) | words[at:at + lanes]
        at += lanes
    shorter = lanes * steps - n
    ids = np.zeros((steps + 2, lanes), np.int64)
    model = _Model()
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)

    def renew(l: np.ndarray, s: np.ndarray, c: np.ndarray) -> None:
        nonlocal at
        for small, _ in _renew(l, s):
            taken = words[at:at + len(small)]
            if len(taken) < len(small):
                raise damaged
            c[small] = c[small] << np.uint64(16) | taken
            at += len(small)

    for t in range(steps):
        live = lanes - (t >= steps - shorter)
        l, s, c, now = low[:live], size[:live], code[:live], ids[t + 2, :live]
        model.predict(ids[t + 1, :live], ids[t, :live])
        s >>= np.uint64(_TOTAL_BITS)
        place = np.minimum((c - l) // s, np.uint64((1 << _TOTAL_BITS) - 1)).view(np.int64)
        of = place >> _ID_BITS
        way = np.where(of < model.w2, 0, 2 - (of < model.w12))
        now[:] = np.where(way == 0, model.id2, model.id1)
        other = np.flatnonzero(way == 2)
        of = model.w12[other]
        now[other] = model.id_at((place[other] - (of << _ID_BITS)) // ((1 << _WAY_BITS) - of))
        escaped = np.flatnonzero(now < 0)
        if len(escaped):
            now[escaped] = model.seen.argmin()  # any id not seen has their interval
        first, width = model.interval(now, way)
        l += s * first
        s *= width
        renew(l, s, c)
        if len(escaped):
            el, es, ec = l[escaped], s[escaped] >> np.uint64(16), c[escaped]
            own = np.minimum((ec - el) // es, np.uint64(0xFFFF))
            el += es * own
            renew(el, es, ec)
            l[escaped], s[escaped], c[escaped] = el, es, ec
            now[escaped] = own
        model.learn(now, way)
    out = np.ascontiguousarray(ids[2:].T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(out.astype("<u4").tobytes()) != check:
        raise damaged
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of ids."""
    return [encode_block(b) for b in blocks]


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """Ids of each payload; a wrong checksum raises ValueError."""
    return [decode_block(p) for p in payloads]


def write_ids(docs: DataFrame, path: str, tokenizer: str | Callable[[], str], end_id: int = END_ID) -> None:
    """Write the ids of all documents, in ascending doc_id order, as block files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer, keeps_space=True), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        buffer, held, table = [], 0, []      # ids of the block that is being filled, its documents
        count = position = doc_no = 0

        def coded() -> pa.RecordBatch:
            nonlocal count, position
            (payload,) = encode_blocks([np.concatenate(buffer)])
            row = {"part": part, "block": count, "position": position, "n_ids": held, "payload": payload,
                   "docs": [{"doc_no": a, "doc_id": b, "n": n} for a, b, n in table]}
            count, position = count + 1, position + held
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("block", pa.int32()), ("position", pa.int64()), ("n_ids", pa.int32()),
                ("payload", pa.binary()), ("docs", pa.list_(pa.struct([("doc_no", pa.int64()), ("doc_id", pa.int64()),
                                                                       ("n", pa.int32())])))]))

        for batch in batches:
            texts = (t or "" for t in batch.column("text").to_pylist())
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids = np.frombuffer(raw + end, "<u4")
                a = 0
                while a < len(ids):
                    take = ids[a:a + BLOCK_IDS - held]
                    buffer.append(take)
                    table.append((doc_no, doc, len(take)))
                    held, a = held + len(take), a + len(take)
                    if held == BLOCK_IDS:
                        yield coded()
                        buffer, held, table = [], 0, []
                doc_no += 1
        if held:
            yield coded()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The runs of ids of each document and block: part, block, doc_no, doc_id, position, ids (binary, little-endian
    unsigned 32-bit)."""

    def decoded(row: dict, docs: pa.StructArray) -> pa.RecordBatch:
        (ids,) = decode_blocks([row["payload"]])
        doc_no, doc_id, n = docs.flatten()
        cuts = np.concatenate(([0], np.cumsum(n.to_numpy(), dtype=np.int64)))
        raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * cuts).astype(np.int32)),
                                                          pa.py_buffer(ids.astype("<u4"))])
        same = [pa.array(np.full(len(n), row[c], np.int32)) for c in ("part", "block")]
        return pa.RecordBatch.from_arrays([*same, doc_no, doc_id, pa.array(row["position"] + cuts[:-1]), raw],
                                          names=["part", "block", "doc_no", "doc_id", "position", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("docs")
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "block", "position", "payload")}
                yield decoded(row, docs[i].values)

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(
        run, "part int, block int, doc_no long, doc_id long, position long, ids binary")


def _crc_shifts() -> list[list[int]]:
    """Operators over GF(2) that move a crc32 past 2 ** k zero bytes, as 32 columns."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]  # past one zero bit

    def square(m: list[int]) -> list[int]:
        return [_apply(m, c) for c in m]

    m = bit
    for _ in range(3):
        m = square(m)
    out = [m]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


def _apply(m: list[int], v: int) -> int:
    x = 0
    for c in m:
        if v & 1:
            x ^= c
        v >>= 1
        if not v:
            break
    return x


def join_crc(crc: int, more: int, n_bytes: int, shifts: list[list[int]]) -> int:
    """crc32 of two runs, from that of each and the second's length."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            crc = _apply(shifts[k], crc)
        n_bytes >>= 1
        k += 1
    return crc ^ more


def document_digests(runs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the runs read back."""
    pieces = runs.select("part", "doc_no", "doc_id", "position", (F.octet_length("ids") / 4).cast("long").alias("n"),
                         F.crc32("ids").alias("crc"))
    whole = pieces.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("position").alias("position"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("position", "n", "crc"))).alias("runs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = _crc_shifts()
        for batch in batches:
            crcs = []
            for pieces_of in batch.column("runs").to_pylist():
                crc = pieces_of[0]["crc"]
                for p in pieces_of[1:]:
                    crc = join_crc(crc, p["crc"], 4 * p["n"], shifts)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "position", "n_tokens")),
                                              pa.array(crcs, pa.int64())],
                                             names=["part", "doc_id", "position", "n_tokens", "ids_crc32"])

    return whole.select("part", "doc_id", "position", "n_tokens", "runs").mapInArrow(
        join, "part int, doc_id long, position long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | Callable[[], str], path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch(spark, "ids")
    write_ids(docs, path, tokenizer)
    # One row for each part, so a window without partitions and the broadcast stay small.
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return document_digests(read_ids(spark, path)).join(F.broadcast(before), "part") \
        .select("doc_id", (F.col("before") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")
