"""Centroid clustering: rounds of exact k-means whose nearest centroids come from a threshold algorithm.

Vectors are turned into integers, so sums, means and distances are exact and no order of rows changes a result.

Assignment. The centroids are sorted by value in every dimension. A vector enters each of these lists at its own value and
walks outward, nearer entry first; a centroid met for the first time gets its exact distance. The entries at the frontier
bound from below what a centroid not met yet can be away: the sum of the frontier's squared differences. The walk of a vector
stops when that sum strictly exceeds its best exact distance (an equal sum may hide a centroid of a smaller number), or when
every centroid was met. All vectors of an Arrow batch walk together as numpy arrays.

Update. Tasks add up their vectors per centroid, Spark adds those partial sums, and k rows of sums reach the driver. Nothing
else is collected, and what is broadcast is k centroids. The integer vectors are written once to the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Larger components would give distances beyond a long; they count as this bound.
LARGEST = 1 << 52
#: Up to this size of components, squared distances of 64 dimensions fit 64-bit arithmetic; beyond it Python's integers are used.
_SAFE = 1 << 27
_LONG = (1 << 63) - 1
#: Vectors that walk at a time.
BLOCK = 4096


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column whose lists all have dims values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors that have exactly dims components, none null, NaN or infinite.

    A component c becomes floor(scale * c), c as double. Repeated rows stay repeated, null ids stay null.
    """
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where(
        (F.size("c") == dims) & F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < math.inf))  # NaN is above infinity in Spark
    )

    def whole(v):
        bound = F.lit(float(LARGEST))
        return F.floor(F.least(bound, F.greatest(-bound, v * F.lit(float(scale))))).cast("bigint")

    return kept.select("vec_id", F.transform("c", whole).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each row; the smaller number wins a tie."""
    kind = np.int64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _SAFE and x.shape[1] <= 128 else object
    x, centroids = x.astype(kind), centroids.astype(kind)
    n, dims = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")  # of each dimension, ascending values
    value = np.take_along_axis(centroids, order, axis=0)
    right = np.empty((n, dims), np.int64)
    for d in range(dims):
        right[:, d] = np.searchsorted(value[:, d], x[:, d])
    left = right - 1
    dim = np.arange(dims)
    met = np.zeros((n, k), bool)
    best, number = np.full(n, -1, kind), np.full(n, k, np.int64)
    walking = np.arange(n)
    while len(walking):
        own, lo, hi = x[walking], left[walking], right[walking]
        below = np.where(lo >= 0, own - value[np.maximum(lo, 0), dim], -1)
        above = np.where(hi < k, value[np.minimum(hi, k - 1), dim] - own, -1)
        down = (below >= 0) & ((above < 0) | (below <= above))  # one of them is there: a list ends only when all were met
        away = np.where(down, below, above)
        entry = order[np.where(down, lo, np.minimum(hi, k - 1)), dim]
        left[walking], right[walking] = lo - down, hi + ~down
        before = met[walking]
        now = before.copy()
        now[np.arange(len(walking))[:, None], entry] = True
        met[walking] = now
        rows, cents = np.nonzero(now & ~before)  # ascending centroids for each row
        far = ((own[rows] - centroids[cents]) ** 2).sum(axis=1)
        for c in range(k):
            at = cents == c
            r, f = walking[rows[at]], far[at]
            better = (best[r] < 0) | (f < best[r]) | ((f == best[r]) & (c < number[r]))
            best[r[better]], number[r[better]] = f[better], c
        frontier = (away**2).sum(axis=1)
        walking = walking[(frontier <= best[walking]) & ~now.all(axis=1)]
    return number, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part.column(0), _matrix(part.column(1), dims)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for rows of `integers`. A distance beyond a long is null."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims):
            number, far = nearest(x, centroids)
            distance = pa.array(far if far.dtype != object else [int(f) if f <= _LONG else None for f in far], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(C.tidied(run), "vec_id bigint, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means, empty ones unchanged."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two limbs of 26 bits: neither overflows before 2^36 vectors of a task.
        count, low, high = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for _, x in _blocks(batches, dims):
            number, _ = nearest(x, centroids)
            for c in range(k):
                own = x[number == c]
                count[c] += len(own)
                low[c] += (own & ((1 << 26) - 1)).sum(axis=0)
                high[c] += (own >> 26).sum(axis=0)
        used = np.flatnonzero(count)
        place = (np.repeat(used, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(used)), np.repeat(count[used], dims))
        yield pa.RecordBatch.from_arrays([*map(pa.array, place), pa.array(low[used].ravel()), pa.array(high[used].ravel())], ["cluster", "d", "n", "low", "high"])

    parts = vectors.select("vec_id", "x").mapInArrow(C.tidied(run), "cluster int, d int, n bigint, low bigint, high bigint")
    totals = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")))
    out = centroids.copy()
    for r in totals.collect():  # k * dims rows at most
        out[r.cluster, r.d] = (int(r.low) + (int(r.high) << 26)) // r.n
    return out


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest lowercase-hex sha256 of `<seed>:<vec_id>`; a null id counts as empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMENSIONS, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that `integers` keeps.

    Other vectors (null, shorter, longer, with a null or non-finite component) have no row. Fewer than k vectors give as many
    centroids; equal vectors and equal centroids are allowed, and the smaller number wins a tie. Repeated rows each count.
    Sums of distances beyond a long are null. No vectors, no rows.
    """
    spark = vectors.sparkSession
    whole = materialise(integers(vectors, id_col, vector_col, dims, scale), "integer_vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    found = materialise(assign(whole, centroids), "assigned")
    big = F.col("distance").cast("decimal(38,0)")
    part = found.groupBy("cluster").agg(F.sum(big).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows at most
    sums = {r.cluster: None if r.lost or r.s > _LONG else int(r.s) for r in part}
    every = None if None in sums.values() or sum(sums.values()) > _LONG else sum(sums.values())
    facts = [(c, s, every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(C.table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in plain SQL: one component a row, a table of centroids for each round."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS}),
x AS MATERIALIZED (
  SELECT r, d, CAST(floor({SCALE} * CAST(e[d] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, {DIMENSIONS + 1}) t(d)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, d, v FROM first JOIN x USING (r))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, c, s FROM (SELECT r, c, CAST(sum((x.v - y.v) * (x.v - y.v)) AS BIGINT) AS s FROM x JOIN c{i} y USING (d) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT c, d, CAST(sum(v) AS BIGINT) AS t, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN n IS NULL THEN v ELSE (t - ((t % n) + n) % n) // n END AS v FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLE_SQL = {"op12_centroids": _sql()}
