"""Centroid clustering (Lloyd's rounds) with ns-bounds: exact assignments, most distances never computed.

Every vector keeps, for each centroid, the squared distance at its last evaluation and the round of that
evaluation. The centroids of all rounds are retained. At a later round a stored distance is a bound that is
loosened by the norm of the centroid's total displacement since that round (||c_now - c_then||), not by the sum of
its moves from round to round, which is never smaller. Where the lower bounds of all other centroids stay
above the upper bound of the own one, nothing is computed. Where a bound fails, the own distance is
evaluated, then the centroids whose bound still fails; of those the nearest wins, ties to the smaller number.
Bounds carry a margin for rounding and distances are whole numbers, so the result is that of a full scan.

On Spark: one narrow pass a round over the written vectors (with their stored distances and rounds, no shuffle); the
sums of a cluster combine in the tasks, so only K rows of sums reach the driver. What goes out with a task is
K x rounds centroids.

Components are floor(scale * x) of finite x. Edge cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; repeated rows count one by one; a null id hashes as the empty text; of rows that
share an id, and so a hash, the smaller vector is the earlier centroid; fewer vectors than K give fewer centroids;
equal centroids leave the later ones empty, and empty ones stay; an empty table gives an empty result; extra columns
are ignored. Components beyond 2 ** 27 after scaling, whose squared distances no long could hold, raise an error, as
overflowing arithmetic does in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketmap.llm.common import stored

DIMENSION, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LARGEST = 1 << 27
_MARGIN = 1e-9
STATE = "vec_id long, v array<int>, cluster int, dist binary, seen binary, n_scans long"


def whole_vectors(embeddings: DataFrame, column: str = "embedding", dimension: int = DIMENSION,
                  scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors, each component x as floor(scale * x)."""
    raw = F.col(column).cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = F.floor(x * scale)
        return F.when(F.abs(x * scale) < LARGEST, y).otherwise(
            F.raise_error(F.lit("a component is too large for whole squared distances"))).cast("int")

    return embeddings.filter((F.size(raw) == dimension) & finite) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(raw, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256("<seed>:<vec_id>"), in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def first_assignment(x: np.ndarray, centroids: np.ndarray):
    """(cluster, dist, seen, scans) of a full scan: round 0."""
    dist = _distances(x, centroids)
    return dist.argmin(axis=1), dist, np.zeros(dist.shape, np.uint8), np.full(len(x), len(centroids))


def bounded_assignment(x: np.ndarray, own: np.ndarray, dist: np.ndarray, seen: np.ndarray, history: list[np.ndarray]):
    """(cluster, dist, seen, scans) at the newest centroids of ``history``; dist and seen are changed in place."""
    now, c = len(history) - 1, history[-1]
    rows, ks = np.arange(len(x)), np.arange(len(c))
    # Norm of the whole way from the centroid of each earlier round to the present one.
    moved = np.sqrt(np.stack([((c - h) ** 2).sum(axis=1) for h in history]).astype(float))
    shift = moved[seen, ks]
    root = np.sqrt(dist.astype(float))
    slack = _MARGIN * (root + shift + 1)
    low = root - shift - slack
    high = (root + shift + slack)[rows, own]
    low[rows, own] = np.inf
    failing = np.flatnonzero((low <= high[:, None]).any(axis=1))
    scans = np.zeros(len(x), np.int64)
    if not len(failing):
        return own, dist, seen, scans
    # The own distance first; it alone settles many.
    mine = own[failing]
    near = ((x[failing] - c[mine]) ** 2).sum(axis=1)
    dist[failing, mine], seen[failing, mine] = near, now
    root = np.sqrt(near.astype(float))
    open_ = low[failing] <= (root + _MARGIN * (root + 1))[:, None]
    scans[failing] = 1 + open_.sum(axis=1)
    best = np.full(open_.shape, np.iinfo(np.int64).max)
    best[np.arange(len(failing)), mine] = near
    for k in ks[open_.any(axis=0)]:
        at = np.flatnonzero(open_[:, k])
        d = ((x[failing[at]] - c[k]) ** 2).sum(axis=1)
        best[at, k] = dist[failing[at], k] = d
        seen[failing[at], k] = now
    own = own.copy()
    own[failing] = best.argmin(axis=1)  # the smallest number among equals
    return own, dist, seen, scans


def _round(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """One assignment of all vectors: full at the first centroids, then by bounds."""
    k, dim = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("v")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
            if len(history) == 1:
                own, dist, seen, scans = first_assignment(x, history[0])
            else:
                own, dist, seen, scans = bounded_assignment(
                    x, batch.column("cluster").to_numpy().astype(np.int64),
                    np.frombuffer(b"".join(batch.column("dist").to_pylist()), "<i8").reshape(n, k).copy(),
                    np.frombuffer(b"".join(batch.column("seen").to_pylist()), np.uint8).reshape(n, k).copy(), history)
                scans = scans + batch.column("n_scans").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists, pa.array(own.astype(np.int32)),
                 pa.array([r.tobytes() for r in dist.astype("<i8")], pa.binary()),
                 pa.array([r.tobytes() for r in seen], pa.binary()), pa.array(scans.astype(np.int64))],
                names=["vec_id", "v", "cluster", "dist", "seen", "n_scans"])

    return stored(state.mapInArrow(run, STATE), "centroid-state")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty cluster's componentwise floor of the mean; the sums combine in the tasks."""
    dim = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in sums.collect():  # one row a cluster
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def _own_distance(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance to the own centroid, n_scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, centroids.shape[1])
            d = ((x - centroids[batch.column("cluster").to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d, pa.int64()),
                                              batch.column("n_scans")], names=["vec_id", "cluster", "distance", "n_scans"])

    return state.select("vec_id", "v", "cluster", "n_scans").mapInArrow(
        run, "vec_id long, cluster int, distance long, n_scans long")


def centroid_clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
                      dimension: int = DIMENSION, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_scans (distances computed for the
    vector in all rounds) of every usable vector."""
    if rounds > 254:
        raise ValueError("the rounds of stored bounds are kept in a byte: at most 254")
    vectors = whole_vectors(embeddings, column, dimension, scale)
    start = first_centroids(vectors, k, seed)
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, "
              "n_scans long")
    if not len(start):
        return embeddings.sparkSession.createDataFrame([], schema)
    history = [start]
    state = _round(vectors, history)
    for _ in range(rounds):
        history.append(_moved(state, history[-1]))
        state = _round(state, history)
    out = stored(_own_distance(state, history[-1]), "centroid-distances")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    by_cluster = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(marks))])
    return out.select("vec_id", "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"),
                      F.lit(sum(sums.values())).cast("long").alias("inertia"),
                      F.array(*map(F.lit, marks))[F.col("cluster")].alias("centroid_sha256"), "n_scans")


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION,
               scale: int = SCALE) -> str:
    """Full scans in every round."""
    steps = [f"""base as materialized (
  select row_number() over () rid, vec_id, sha256('{seed}:' || coalesce(vec_id::varchar, '')) h,
    list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v
  from embeddings where len(embedding) = {dimension}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimension}),
c0 as materialized (select row_number() over (order by h, v) - 1 k, v c from (select h, v from base order by h, v limit {k}))"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (
  select rid, arg_min(k, d * 1000 + k) k, min(d) d from (
    select rid, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint d
    from base, c{t}) group by rid)""")
        if t < rounds:
            steps.append(f"""c{t + 1} as materialized (
  select o.k, coalesce(n.c, o.c) c from c{t} o left join (
    select k, list((s - ((s % n) + n) % n) // n order by i)::bigint[] c from (
      select k, i, sum(v[i])::bigint s, count(*) n from a{t} join base using (rid), range(1, {dimension + 1}) r(i)
      group by k, i) group by k) n on n.k = o.k)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, a{rounds}.k::int as cluster, d::bigint as distance, (sum(d) over (partition by a{rounds}.k))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join base using (rid) join c{rounds} using (k)"""
