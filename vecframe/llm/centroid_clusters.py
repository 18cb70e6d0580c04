"""Clustering around centroids, with the nearest centroid found by the threshold algorithm.

For every dimension the centroids are held sorted by that component. From the place of a vector's own value the
list is walked outward, the nearer neighbour first; a centroid met in any list gets its exact distance. A centroid
met in none is at least as far off in each dimension as the frontier there, so the walk ends as soon as the sum of
the squared frontier distances is strictly more than the best exact distance: no unmet centroid can win or tie.
A task walks a block of vectors at once, each only until it is settled.

Vectors are whole numbers, so distances, sums and means are exact, and the order of tasks does not matter. A round
reads the stored vectors once and shuffles one short row per task and cluster; only the centroids (`k` rows) and
their sums come to the driver.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out;
repeated rows count each; a null id sorts last among the first centroids, of equal ids the smaller vector is first;
ties between centroids go to the smaller number; fewer vectors than `k` give that many centroids; an empty table
gives no rows. Components of more than 2^27 in size raise an error, as their distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.llm.common import col
from vecframe.session import ship, write_and_read

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
# Vectors that walk together; pairs of vector and centroid whose distances are taken at once.
BLOCK, PAIRS = 4096, 16_384
LARGEST = 1 << 27
# A cluster of so many vectors could pass the range of a long in its sums.
MOST = 1 << 36


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (array of longs) of the vectors that count, stored."""
    given = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("raw", lambda x: F.floor(x * F.lit(float(scale))))
    # Beyond 2^27 a component fails at once: a later floor would silently end at the largest long.
    small = F.transform("raw", lambda x: F.abs(x * F.lit(float(scale))) <= LARGEST)
    checked = F.when(F.forall(small, lambda s: s), scaled).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("array<bigint>")
    )
    return write_and_read(
        given.where((F.size("raw") == dims) & fine).select("vec_id", checked.alias("vec")), "whole-vectors"
    )


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest digests of `seed:vec_id`, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "vec").orderBy(F.asc_nulls_last("digest"), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, squared distance, and how many distances were taken, per vector."""
    out = [_walk(vectors[i:i + BLOCK], centroids) for i in range(0, len(vectors), BLOCK)]
    if not out:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _walk(vectors: np.ndarray, centroids: np.ndarray):
    n, dims = vectors.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable").T  # dims x k: numbers of the centroids
    values = np.take_along_axis(centroids.T, order, axis=1)
    # A sentinel on either side is never the nearer one while a centroid is left.
    far = np.full((dims, 1), 1 << 40)
    values = np.ascontiguousarray(np.hstack([-far, values, far]))
    numbers = np.ascontiguousarray(np.hstack([np.full((dims, 1), k), order, np.full((dims, 1), k)])).ravel()
    flat, base = values.ravel(), np.arange(dims) * (k + 2)
    right = np.stack([np.searchsorted(values[d, 1:-1], vectors[:, d]) for d in range(dims)], axis=1) + 1 + base
    left = right - 1
    below, above = vectors - flat[left], flat[right] - vectors

    best = np.full(n, np.iinfo(np.int64).max)
    winner = np.full(n, k)
    taken = np.zeros(n, dtype=np.int64)
    live, seen = np.arange(n), np.zeros((n, k + 1), dtype=bool)
    seen[:, k] = True
    for _ in range(k):
        # One step outward in every list of every vector that is not settled.
        step_left = below <= above
        frontier = np.where(step_left, below, above)
        met = numbers[np.where(step_left, left, right)]
        left = left - step_left
        right = right + ~step_left
        new = np.zeros((len(live), k + 1), dtype=bool)
        np.put_along_axis(new, met, True, axis=1)
        new &= ~seen[live]
        seen[live] |= new
        rows, found = np.nonzero(new)
        _measure(vectors, centroids, live[rows], found, best, winner)
        taken[live] += new.sum(axis=1)
        # An ended list has met every centroid, so none is unmet.
        going = (frontier * frontier).sum(axis=1) <= best[live]
        going &= ~seen[live].all(axis=1)
        if not going.any():
            break
        live, left, right = live[going], left[going], right[going]
        below, above = vectors[live] - flat[left], flat[right] - vectors[live]
    return winner, best, taken


def _measure(vectors, centroids, rows, found, best, winner) -> None:
    """Exact distances of the given pairs (ordered by row, then centroid); ties go to the smaller number."""
    for i in range(0, len(rows), PAIRS):
        r, c = rows[i:i + PAIRS], found[i:i + PAIRS]
        gap = vectors[r] - centroids[c]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        least = np.minimum.reduceat(distance, starts)
        # The first place of the least distance in each row.
        at = np.flatnonzero(distance == np.repeat(least, np.diff(starts, append=len(r))))
        at = at[np.diff(r[at], prepend=-1) != 0]
        r, c = r[starts], c[at]
        better = (least < best[r]) | ((least == best[r]) & (c < winner[r]))
        best[r[better]], winner[r[better]] = least[better], c[better]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vec")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each cluster's vectors; an empty cluster keeps its centroid."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def rows_of(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(np.arange(0, len(some) * dims + 1, dims, dtype=np.int32), total[some].ravel())
        return pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": count[some], "vec": sums})

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            matrix = _matrix(batch)
            cluster = nearest(matrix, shared.value)[0]
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, matrix)
        yield rows_of(count, total)

    def by_cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            np.add.at(count, cluster, batch.column("n").to_numpy())
            np.add.at(total, cluster, _matrix(batch))
        yield rows_of(count, total)

    partial = vectors.select("vec").mapInArrow(by_task, "cluster int, n long, vec array<long>")
    summed = partial.repartition("cluster").mapInArrow(by_cluster, partial.schema)
    moved = centroids.copy()
    for r in summed.collect():
        if r["n"] >= MOST:
            raise OverflowError(f"cluster {r['cluster']} has too many vectors for exact sums")
        moved[r["cluster"]] = [total // r["n"] for total in r["vec"]]
    shared.unpersist()
    return moved


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, compared (how many centroids' distances were taken)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, compared = nearest(_matrix(batch), shared.value)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": distance,
                "compared": pa.array(compared, pa.int32()),
            })

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, compared int")


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance, compared per vector; cluster, centroid, digest, n, inertia per centroid)."""
    spark = ship(vectors.sparkSession)
    stored = whole_vectors(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(stored, k, seed).reshape(-1, dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(stored, centroids)
    placed = write_and_read(assign(stored, centroids), "clusters")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, c, d) for i, (c, d) in enumerate(zip(centroids.tolist(), digests, strict=True))]
    named = spark.createDataFrame(rows, "cluster int, centroid array<long>, digest string")
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"))
    # At most k rows on both sides.
    return placed, named.join(F.broadcast(sums), "cluster", "left").fillna(0, ["n", "inertia"])


def with_inertia(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each vector with its cluster's digest and inertia, and the inertia of all."""
    every = clusters.agg(F.sum("inertia").alias("all"))
    few = clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("digest").alias("centroid_sha256"))
    # One row for each of the k clusters, and one for all.
    joined = placed.join(F.broadcast(few), "cluster")
    return joined.withColumn("inertia", F.lit(every.first()["all"]).cast("long"))
