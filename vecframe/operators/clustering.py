"""k-means fits, nearest-centroid assignment, cell sizes and the ranking of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecframe.operators.kernel import CellSums, list_matrix, nearest, squares, usable
from vecframe.operators.knn import Limits, knn_join
from vecframe.operators.sampling import train_prefix
from vecframe.session import free_name, ship, write_and_read

CENTROIDS = "cell int, centroid array<double>"
# Centroids that may be sent to every task.
_MODEL_ROWS, _MODEL_BYTES = 50_000, 64 << 20
# Bytes of sums that a task holds before it passes them on.
_SUM_BYTES = 64 << 20


def centroid_table(spark: SparkSession, centers, cells=None) -> DataFrame:
    """`cell, centroid` from a sequence of vectors, numbered in order unless `cells` is given."""
    table = pa.table({
        "cell": pa.array(range(len(centers)) if cells is None else cells, pa.int32()),
        "centroid": pa.array([np.asarray(c, dtype=np.float64) for c in centers], pa.list_(pa.float64())),
    })
    return spark.createDataFrame(table, CENTROIDS)


def _centers(centroids: DataFrame):
    """(cells, matrix) on the driver if the model is small enough to send around, else None; computed once."""
    rows = centroids.select(F.col("cell").cast("long"), "centroid").limit(_MODEL_ROWS + 1).toArrow()
    if rows.num_rows == 0:
        raise ValueError("no centroids")
    if rows.num_rows > _MODEL_ROWS or rows.nbytes > _MODEL_BYTES:
        return None
    rows = rows.sort_by("cell")
    return rows.column("cell").to_numpy(), list_matrix(rows.column("centroid"))


def assign_cells(
    df: DataFrame, centroids: DataFrame, features: str = "features", column: str = "cell"
) -> DataFrame:
    """Add the cell of the nearest centroid (Euclidean) to every row, without a shuffle.

    A model too large to send to every task is searched by the nearest-neighbour join instead.
    """
    spark = ship(df.sparkSession)
    model = _centers(centroids)
    if model is None:
        return _assign_by_join(df, centroids, features, column)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def cell_of(vectors: pa.Array) -> pa.Array:
        cells, centers = shared.value
        present = np.asarray(vectors.is_valid())
        out = np.full(len(vectors), -1)
        if present.any():
            out[present] = nearest(list_matrix(vectors.filter(pa.array(present))), cells, centers)
        return pa.array(out, pa.int32(), mask=out < 0)

    return df.withColumn(column, cell_of(F.col(features)))


def _assign_by_join(df, centroids, features, column):
    # Rows get a number of their own, stored, so that repeated or missing ids make no difference.
    row = free_name(df, "_row")
    rows = write_and_read(df.withColumn(row, F.monotonically_increasing_id()), "unassigned")
    vectors = rows.select(F.col(row).alias("row"), F.col(features).alias("vector"))
    centers = centroids.select("cell", F.col("centroid").alias("vector"))
    found = knn_join(vectors, centers, 1, "l2", query_id="row", base_id="cell", features="vector")
    cells = found.select(F.col("qid").alias(row), F.col("neighbor").cast("int").alias(column))
    return rows.drop(column).join(cells, row, "left").drop(row)


def _mean_values(df: DataFrame, columns: list, cells_of) -> DataFrame:
    """`cell, centroid`: tasks sum their rows and pass one array per cell on, which one task per cell adds up."""

    def by_task(batches):
        total = CellSums()
        for batch in batches:
            vectors = list_matrix(batch.column("vec"))
            if len(vectors):
                total.add(cells_of(batch, vectors), vectors)
            if total.bytes() > _SUM_BYTES:
                yield total.batch()
                total = CellSums()
        yield total.batch()

    def by_cell(batches):
        total = CellSums()
        for batch in batches:
            total.merge(batch)
        yield total.means()

    partial = df.select(*columns).where("vec is not null").mapInArrow(by_task, "cell int, n long, sums array<double>")
    return partial.repartition("cell").mapInArrow(by_cell, CENTROIDS)


def mean_vectors(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """`cell, centroid`: the mean vector of every value of a non-negative integer column."""
    ship(df.sparkSession)
    columns = [F.col(features).alias("vec"), F.coalesce(F.col(key).cast("int"), F.lit(-1)).alias("key")]
    return _mean_values(df, columns, lambda batch, _: batch.column("key").to_numpy(zero_copy_only=False))


def kmeans_lloyd(
    df: DataFrame, initial: DataFrame, iterations: int, features: str = "features"
) -> DataFrame:
    """`cell, centroid` after a fixed number of Lloyd steps from given centroids.

    Each step is one pass over the vectors: tasks assign and sum their rows, and one short row per
    task and cell is shuffled. Only centroids visit the driver. A cell that loses all its rows
    keeps its centroid. A model too large to send around stays a table: its steps assign rows by
    the nearest-neighbour join, and centroids are stored from step to step.
    """
    spark = ship(df.sparkSession)
    model = _centers(initial)
    if model is None:
        return _lloyd_by_join(df, initial, iterations, features)
    cells, centers = model
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((cells, centers))
        step = _mean_values(
            df, [F.col(features).alias("vec")],
            lambda batch, vectors, model=shared: nearest(vectors, *model.value),
        ).toArrow()
        centers = np.array(centers, dtype=np.float64)
        if step.num_rows:
            row = np.searchsorted(cells, step.column("cell").to_numpy())
            centers[row] = list_matrix(step.column("centroid"))
    return centroid_table(spark, centers, cells)


def _lloyd_by_join(df, initial, iterations, features):
    current = write_and_read(initial.select(F.col("cell").cast("int").alias("cell"), "centroid"), "centroids")
    for _ in range(iterations):
        assigned = _assign_by_join(df.select(features), current, features, "cell")
        moved = mean_vectors(assigned, "cell", features).withColumnRenamed("centroid", "moved")
        current = write_and_read(
            current.join(moved, "cell", "left").select("cell", F.coalesce("moved", "centroid").alias("centroid")),
            "centroids",
        )
    return current


def fit_kmeans(
    df: DataFrame,
    k: int,
    seed: int = 0,
    train_rows: int | None = None,
    max_iter: int = 20,
    features: str = "features",
    id_col: str = "id",
):
    """A Spark ML k-means model fitted on the first `train_rows` rows by id (None: on all)."""
    train = df if train_rows is None else df.where(F.col(id_col) < train_rows)
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="vector", predictionCol="cell").fit(
        _as_vector(train, features)
    )


def _as_vector(df, features):
    return df.withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))


def attach_cells(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Add the label of a fitted model to every row."""
    return model.transform(_as_vector(df, features)).drop("vector")


def fit_levels(
    df: DataFrame, sizes: list[int], train_rate: float = 0.05, seed: int = 0, max_iter: int = 20
) -> list[DataFrame]:
    """Centroid tables of independent fits with the given numbers of cells, on one training prefix."""
    # A prefix sits in few files; spread it, because every iteration passes over it.
    tasks = df.sparkSession.sparkContext.defaultParallelism
    train = train_prefix(df, train_rate).select("id", "features").repartition(tasks, "id").persist()
    try:
        models = [fit_kmeans(train, k, seed, max_iter=max_iter) for k in sizes]
    finally:
        train.unpersist()
    return [centroid_table(df.sparkSession, m.clusterCenters()) for m in models]


def fit_two_levels(
    df: DataFrame, k1: int, k2: int, train_rate: float = 0.05, seed: int = 0, max_iter: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(fine, coarse) centroids: k2 cells for assignment, k1 anchors for packing."""
    fine, coarse = fit_levels(df, [k2, k1], train_rate, seed, max_iter)
    return fine, coarse


def cell_counts(df: DataFrame, n_cells: int, cell: str = "cell") -> DataFrame:
    """`cell, n` for every cell 0..n_cells-1, empty cells included."""
    cells = df.sparkSession.range(n_cells).select(F.col("id").cast("int").alias("cell"))
    counted = df.groupBy(F.col(cell).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    return cells.join(counted, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_cells(
    coarse: DataFrame, fine: DataFrame, metric: str = "cosine", limits: Limits = Limits()
) -> DataFrame:
    """`coarse, cell, distance, rank`: all fine cells in order of distance from each coarse one.

    A packing needs no such table: `balance_near` ranks cells as far as it looks at them.
    Pairs without a distance (a zero centroid under cosine) come last, in cell order.
    """
    anchors, cells = _centers(coarse), _centers(fine)
    if anchors is None or cells is None:
        raise ValueError("the centroids are too many to be ranked")
    ranked = knn_join(
        coarse, fine, len(cells[0]), metric,
        query_id="cell", base_id="cell", features="centroid", limits=limits,
    ).select(
        F.col("qid").cast("int").alias("coarse"), F.col("neighbor").cast("int").alias("cell"),
        "distance", F.col("rank").cast("int"),
    )
    if all(usable(squares(centers), metric).all() for _, centers in (anchors, cells)):
        return ranked
    listed = F.split(F.lit(",".join(str(c) for c in cells[0])), ",").cast("array<int>")
    pairs = coarse.select(F.col("cell").cast("int").alias("coarse"), F.explode(listed).alias("cell"))
    order = Window.partitionBy("coarse").orderBy(F.col("rank").asc_nulls_last(), "cell")
    return pairs.join(ranked, ["coarse", "cell"], "left").withColumn("rank", F.row_number().over(order))
