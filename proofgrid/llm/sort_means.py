"""Centroid clustering by sort-means, exact in whole numbers.

Vectors are turned into whole numbers, so distances, sums and ties are exact. In each round, the other centroids are
ordered by their distance from each centroid. A vector's scan begins at the centroid of its last assignment, whose
distance is looked up first, and goes through the others in that order; it stops at the first one that lies strictly
beyond twice the vector's distance, since by the triangle inequality no later one can be nearer or as near. (Squares
are compared: beyond four times the squared distance.) Scans of a block of vectors run side by side in numpy.

What tasks are sent is the centroids with their orders, what they give back is their sums for each centroid: both are
bounded by the number of centroids and components, whatever the number of vectors. A round is one pass over a written
table, which holds the vectors with their assignments.

Defined cases: a vector that is null, has another number of components, or a null or non-finite one, isn't kept;
repeated rows are vectors of their own, and as starting centroids too; a row without vec_id is clustered but is no
starting centroid; fewer vectors than centroids give as many centroids as there are; equal distances go to the smaller
number; an empty cluster keeps its centroid; an empty table gives an empty one; extra columns are ignored. Components
beyond LARGEST in size, whose squared distances could pass 64 bits, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, lean, materialize, read

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2:"
#: Largest size of a component as a whole number.
LARGEST = 1 << 27
#: Vectors whose scans run side by side.
BLOCK = 4096
_STATE = "vec_id long, v array<int>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, v: the kept ones in whole numbers. No shuffle."""
    x = F.col("embedding").cast("array<double>")
    kept = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = lambda c: F.when(F.abs(c) < LARGEST / scale, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return vectors.where(F.col("embedding").isNotNull()).where(kept).select(F.col("vec_id").cast("long"), F.transform(x, small).alias("v"))


def starting(kept: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these."""
    first = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "v").orderBy("hash", "v").limit(clusters).collect()  # clusters rows
    return np.array([r.v for r in first], np.int64)


def sort_means(v: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector, from its last assignment on."""
    apart = np.stack([np.square(centroids - c).sum(1) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, axis=1)
    best, who = np.square(v - centroids[last]).sum(1), last.copy()
    current = 4 * best  # a centroid beyond twice the distance is beyond four times its square
    scanning = np.arange(len(v))
    for k in range(len(centroids)):
        scanning = scanning[apart[last[scanning], k] <= current[scanning]]
        if not len(scanning):
            break
        candidate = order[last[scanning], k]
        d = np.square(v[scanning] - centroids[candidate]).sum(1)
        nearer = (d < best[scanning]) | ((d == best[scanning]) & (candidate < who[scanning]))
        at = scanning[nearer]
        best[at], who[at] = d[nearer], candidate[nearer]
    return who, best


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def assign(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """state(vec_id, v, cluster) with the nearest centroid of each vector. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                who, best = sort_means(_matrix(part["v"]), part["cluster"].to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(lean(run), _STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the clusters of state; sums are made in the tasks first, a row for each cluster and component."""
    shape = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for batch in batches:
            who = batch["cluster"].to_numpy()
            np.add.at(total, who, _matrix(batch["v"]))
            n += np.bincount(who, minlength=shape[0])
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(lean(run), "cluster int, n long, sums array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(shape[1])]).alias("sums"))
    after = centroids.copy()
    for row in summed.collect():  # a row for each cluster
        after[row.cluster] = [total // row.n for total in row.sums]
    return after


def clustered(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids after all rounds."""
    kept = materialize(whole_vectors(vectors, dimensions, scale), "vectors")
    centroids = starting(kept, clusters, salt)
    if not len(centroids):
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = kept.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        after = materialize(assign(state, centroids), "assigned")
        discard(state)
        centroids, state = moved(after, centroids), after
    last = materialize(assign(state, centroids).select("vec_id", "cluster", "distance"), "clusters")
    discard(state)
    return last, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256. What is sent to all tasks is a row for each centroid."""
    spark = assigned.sparkSession
    prints = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    within = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    every = sum(within.values())
    rows = [(k, within.get(k, 0), every, p) for k, p in prints]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(read(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The same clusters by comparing every vector with every centroid, round by round."""
    component = f"CASE WHEN len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) END"
    parts = [
        f"kept AS (SELECT vec_id, v, row_number() OVER () AS r FROM (SELECT vec_id, {component} AS v FROM embeddings) WHERE v IS NOT NULL)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SALT}' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS}))",
    ]
    near = "n{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k}}) AS best FROM kept CROSS JOIN c{i} GROUP BY r)"
    for i in range(ROUNDS):
        parts.append(near.format(i=i))
        parts.append(
            f"s{i} AS (SELECT best.k AS k, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM n{i} CROSS JOIN range(1, {DIMENSIONS + 1}) t(j) GROUP BY best.k, j), "
            f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k), c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)"
        )
    parts.append(near.format(i=ROUNDS))
    last = f"SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance FROM n{ROUNDS}"
    return (
        f"WITH {', '.join(parts)}, a AS ({last}) SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} ON cluster = k"
    )


SQL = _sql()
