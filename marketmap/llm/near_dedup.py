"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every document becomes its set of distinct word shingles (64-bit hashes) and a MinHash signature
   of BANDS x ROWS values. Documents with the same set are one class, held by its smallest id.
2. Classes that agree in all values of a band share a bucket. At the similarity threshold 0.8 a pair
   shares none of the 40 buckets with probability (1 - 0.8^5)^40, about 1e-7.
3. A candidate pair is compared in batches of signature values. After each batch it is dropped when
   the posterior probability (uniform prior) that its similarity reaches the threshold is under
   MISS. Pairs that survive are verified on their full shingle sets.
4. Verified links are joined to components. Links only matter between components, so a bucket is not
   expanded into all its pairs: first every member meets two members of its bucket (in a bucket of
   three that is every pair) and the components are formed. Buckets of more that still hold several components
   go on as groups: overlapping buckets as one group, or each on its own where that makes fewer
   comparisons. A group is cut into blocks, and every two blocks of it are compared in one task, which
   holds at most 2 * GROUP_BLOCK members, takes only pairs of different components, prunes and verifies
   them as above, and returns no more links than join its members. No candidate pair between different
   components is left out, whatever the size of its bucket.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case. A text of fewer words than a
shingle is one shingle; null or wordless text has an empty set and is linked with nothing. Repeated rows of
one id are one document for linking; rows with a null id are linked, but never name a component; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmap.llm.common import join_to_heavy_keys, stored
from marketmap.llm.components import connected_components

ROWS, BANDS, BATCH, MISS = 5, 40, 40, 1e-7
HASHES = ROWS * BANDS
#: Members of a block; two blocks are compared in one task.
GROUP_BLOCK = 512
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, modulo 2 ** 64, for i < n (grown as needed, kept for the process)."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = []
    for a, b in _runs(raw):
        data = raw[a:b]
        inside = ~_SPACE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(len(data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * power[:len(data)])))
        out.append(_mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _runs(raw: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut long texts at white space into pieces of about ``size`` bytes."""
    a = 0
    while a < len(raw):
        b = min(a + size, len(raw))
        while b < len(raw):
            gap = np.flatnonzero(_SPACE[raw[b:b + size]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + size, len(raw))
        yield a, b
        a = b


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        best = np.minimum(best, (x[a:a + 1024, None] * _MUL + _ADD).min(axis=0))
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[r::ROWS].astype(np.uint64))
    return h.view(np.int64)


def least_matches(percent: int, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch end: a pair with fewer matches so far is pruned. With a uniform prior the similarity
    after m of n matches is Beta(m + 1, n - m + 1); its mass at or over the threshold is summed on a grid."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(batch, HASHES + 1, batch):
        for m in range(n + 1):
            like = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(like - like.max())
            if like[s >= percent / 100].sum() >= miss * like.sum():
                break
        out.append(m)
    return out


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set), sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, n) of every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            keys = [band_keys(np.frombuffer(s, np.uint32)) for s in sigs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)),
                 pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)),
                 pa.array(np.repeat(batch.column("n").to_numpy(zero_copy_only=False), BANDS))], names=["bucket", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(run, "bucket long, node long, n long")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return texts.join(nodes, "node", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sequential comparison of their signatures does not prune."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES)
                    for c in ("sig_a", "sig_b"))
            live, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, need in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                seen[live] += (x[live, part] == y[live, part]).sum(axis=1)
                live = live[seen[live] >= need]
            yield batch.select(["a", "b"]).take(pa.array(live))

    sig = classes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    likely = _likely(pairs, classes, percent).distinct()
    both = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("i", common).filter(
        F.col("i") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("i")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their shingle sets have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable over links."""
    sketch = stored(_sketch(docs, words), "near-sketch")
    classes = stored(sketch.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.min_by("sig", "doc_id").alias("sig"))
        .filter("node is not null"), "near-classes")
    rows = _buckets(classes)
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = stored(rows.join(shared, "bucket"), "near-buckets")
    sets = stored(_sets(docs, buckets.select("node").distinct(), words), "near-sets")

    links = stored(_verified(_meetings(buckets, percent), classes, sets, percent), "near-links")
    labels = connected_components(links, "near-labels")
    members = stored(_unsettled(buckets.filter("size > 3"), labels), "near-members")
    more = stored(_group_links(_groups(members), classes, sets, percent), "near-links")
    labels = connected_components(links.unionByName(more), "near-labels")
    by_class = classes.select("set_key", "node").join(labels, "node", "left") \
        .select("set_key", F.coalesce("component", "node").alias("component"))
    return sketch.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with the bucket's first and last member in an order by hash: at most two
    pairs a member. The extremes combine before the shuffle."""
    order = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    ends = members.groupBy("bucket").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    met = members.join(ends, "bucket").select("node", "n", F.explode(F.array("first", "last")).alias("other"))
    return met.filter(F.col("node") != F.col("other.node")).filter(_close_in_size("n", "other.n", percent)) \
        .select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()


def _unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with it."""
    now = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                        F.min("node").alias("first")).filter("x < y").select("bucket", "first")
    return now.join(several, "bucket").select("bucket", "first", "size", "node", "component")


def _groups(members: DataFrame) -> DataFrame:
    """(group, node, component): overlapping buckets as one group, or one by one, whichever compares less."""
    linked = connected_components(members.select(F.col("node").alias("a"), F.col("first").alias("b")), "near-clusters") \
        .withColumnRenamed("component", "cluster")
    # A cluster is that of its buckets' first nodes, so it is decided on one row for each bucket.
    buckets = stored(members.groupBy("bucket").agg(F.first("first").alias("node"), F.first("size").cast("double").alias("s"))
                     .join(linked, "node").select("bucket", "cluster", "s"), "near-bucket-clusters")
    apart = buckets.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("apart"), F.count(F.lit(1)).alias("buckets"))
    together = linked.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("g"))
    choice = stored(apart.join(together, "cluster").select(
        "cluster", (F.col("g") * F.col("g") <= F.col("apart")).alias("as_one"), "buckets"), "near-choice")
    chosen = join_to_heavy_keys(buckets.select("bucket", "cluster"), choice, "cluster", "buckets")
    sized = chosen.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), "bucket")
    return join_to_heavy_keys(members, stored(sized.select("bucket", "cluster", "as_one", "rows"), "near-chosen"), "bucket", "rows").select(
        F.struct("as_one", F.when(F.col("as_one"), F.col("cluster")).otherwise(F.col("bucket")).alias("id")).alias("group"),
        "node", "component").distinct()


def _group_links(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the members of each group, block against block."""
    groups = stored(groups, "near-groups")
    size = stored(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"),
                                              F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks")), "near-sizes")
    rows = join_to_heavy_keys(groups, size, "group", "n").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                       "node", "component")
    least = least_matches(percent)

    def compare(table: pa.Table) -> pa.Table:
        links = _compare_blocks(table, least, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    full = rows.join(classes.select("node", "sig"), "node").join(sets, "node")
    return full.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long")


def _compare_blocks(table: pa.Table, least: list[int], percent: int) -> list[tuple[int, int]]:
    """Verified links between the two blocks of the table (or inside its one), enough to join their members."""
    table = table.sort_by([("own", "ascending"), ("node", "ascending")]).combine_chunks()
    node = table.column("node").to_numpy()
    own = table.column("own").to_numpy()
    label = {c: c for c in table.column("component").to_pylist()}

    def root(c):
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    component = table.column("component").to_pylist()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    lists = table.column("shingles").combine_chunks()
    offset = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    size = np.diff(offset)
    _, shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    held = np.zeros(int(shingle.max(initial=-1)) + 1, bool)
    split = int(np.searchsorted(own, own[-1]))  # the second block begins here; 0 if there is one
    out = []
    for a in range(split or len(node)):
        now = np.array([root(c) for c in component])
        near = np.arange(split or a + 1, len(node))
        near = near[(now[near] != now[a]) & (np.minimum(size[near], size[a]) * 100 >= np.maximum(size[near], size[a]) * percent)]
        seen = np.zeros(len(near), np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            seen += (sig[near, part] == sig[a, part]).sum(axis=1)
            near, seen = near[seen >= need], seen[seen >= need]
        if not len(near):
            continue
        held[shingle[offset[a]:offset[a + 1]]] = True
        for b in near.tolist():
            if root(component[b]) == root(component[a]):
                continue
            common = int(held[shingle[offset[b]:offset[b + 1]]].sum())
            if 100 * common >= percent * (size[a] + size[b] - common):
                out.append((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
                label[root(component[b])] = root(component[a])
        held[shingle[offset[a]:offset[a + 1]]] = False
    return out


def _close_in_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


# Near duplicates with two-word shingles at 80 percent: sets compared directly, texts with equal sets once.
ORACLE_SQL = r"""with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from texts),
same as (select doc_id, s, len(s) as n, case when len(s) > 0 then min(doc_id) over (partition by s) else doc_id end as rep from sets),
reps as (select doc_id, n, unnest(s) as shingle from same where doc_id = rep and n > 0),
links as (select a.doc_id as a, b.doc_id as b from reps a join reps b on a.shingle = b.shingle and a.doc_id < b.doc_id
    and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as seen from same where doc_id = rep
  union select r.node, e.b from reach r join edges e on e.a = r.seen),
lowest as (select node, min(seen) as component_id from reach group by node)
select s.doc_id, cast(s.n as bigint) as n_shingles, l.component_id, s.doc_id = l.component_id as kept
from same s join lowest l on l.node = s.rep"""
