"""Dataset loading, positional row ids, and saved clustering models."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecframe.session import write_and_read
from vecframe.sources.vecs import read_fvecs, read_ivecs

# Input splits whose row offsets are sent to every task, at 16 bytes each.
_SPLITS = 2_000_000


class Dataset(NamedTuple):
    base: DataFrame  # id, features
    queries: DataFrame  # qid, features
    truth: DataFrame  # qid, neighbors (nearest first)
    learn: DataFrame | None = None  # id, features


def read_dataset(
    spark: SparkSession, base: str, queries: str, truth: str, learn: str | None = None
) -> Dataset:
    """The tables of one benchmark dataset, lazily, from fvecs/ivecs files or Parquet.

    A path ending in `.fvecs` / `.ivecs` is read in that format, any other as Parquet with the
    columns named above.
    """

    def vectors(path):
        return read_fvecs(spark, path) if path.rstrip("/").endswith(".fvecs") else spark.read.parquet(path)

    def neighbors(path):
        if not path.rstrip("/").endswith(".ivecs"):
            return spark.read.parquet(path)
        rows = read_ivecs(spark, path).withColumnRenamed("id", "qid")
        return rows.withColumn("neighbors", F.col("neighbors").cast("array<long>"))

    asked = vectors(queries)
    if "qid" not in asked.columns:
        asked = asked.withColumnRenamed("id", "qid")
    return Dataset(vectors(base), asked, neighbors(truth), vectors(learn) if learn else None)


def with_row_id(scan: DataFrame, column: str = "id") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... in file-name and in-file order, without a shuffle of the rows.

    `scan` must be a plain file read. The numbers do not depend on how a job splits the files: Parquet gives
    every row its place in its file, so only rows per file are counted; other formats are stored once with
    their places (file, split, place in the split), and all later reads see that table. A row of a file that
    was not there when the rows were counted is an error, not a lost row.
    """
    spark = scan.sparkSession
    others = [c for c in scan.columns if c != column]
    if "row_index" in scan.select("_metadata").schema[0].dataType.names:
        place = F.col("_metadata.row_index")
        placed = scan.select(*others, F.col("_metadata.file_path").alias("_file"), F.lit(0).alias("_block"), place.alias("_place"))
    else:
        placed = write_and_read(
            scan.select(
                *others, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_place"),
            ), "numbered",
        )
    placed = placed.withColumn("_split", F.xxhash64("_file", "_block"))
    splits = placed.groupBy("_file", "_block", "_split").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    # One row per file or input split, so this unpartitioned window sees metadata only.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    shifts = splits.select("_file", "_block", "_split", shift)
    key = ["_file", "_block"]
    head = shifts.select("_split", "_shift").limit(_SPLITS + 1).toArrow()
    if head.num_rows <= _SPLITS and pc.count_distinct(head.column("_split")).as_py() == head.num_rows:
        shifts, key = F.broadcast(spark.createDataFrame(head, "_split long, _shift long")), ["_split"]
    else:
        shifts = write_and_read(shifts.drop("_split"), "offsets")
    lost = F.raise_error(F.concat(F.lit("rows were added after the files were counted: "), F.col("_file")))
    number = F.col("_place") + F.coalesce("_shift", lost.cast("long"))
    return placed.join(shifts, key, "left").select(number.alias(column), *others)


def check_dense(df: DataFrame, column: str = "id") -> int:
    """The number of rows; an error unless `column` holds 0 to that number less one, once each, as positional rules need.

    Sums and sums of squares tell repeated numbers, in one pass without a shuffle of the column.
    """
    exact = F.col(column).cast("decimal(19,0)")
    n, least, most, total, square = df.agg(
        F.count("*"), F.min(column), F.max(column), F.try_sum(exact), F.try_sum(exact * exact)
    ).first()
    if not n:
        return 0
    if least != 0 or most != n - 1:
        raise ValueError(f"`{column}` must run from 0 to {n - 1}, not from {least} to {most}; see with_row_id")
    if total != n * (n - 1) // 2 or square != n * (n - 1) * (2 * n - 1) // 6:
        raise ValueError(f"`{column}` must run from 0 to {n - 1}, but some numbers are repeated or null")
    return n


def zip_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair row i of one file scan with row i of another: `id` and the columns of both."""
    return with_row_id(left).join(with_row_id(right), "id")


def save_centroids(centroids: DataFrame, path: str) -> None:
    """Headerless CSV, one line per cell in cell order. A model-sized table: one file.

    The line number is the cell, so cells must be numbered 0, 1, 2, ...
    """
    check_dense(centroids, "cell")
    line = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    centroids.coalesce(1).sortWithinPartitions("cell").select(line).write.text(path)


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    """`cell, centroid` from headerless CSV; the cell is the line number."""
    lines = with_row_id(spark.read.text(path), "cell")
    values = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double"))
    return lines.select(F.col("cell").cast("int"), values.alias("centroid"))


def save_assignment(assigned: DataFrame, path: str) -> None:
    """Headerless CSV of one cell number per line, line i belonging to vector i; ids must be 0, 1, 2, ..."""
    check_dense(assigned)
    assigned.orderBy("id").select(F.col("cell").cast("string")).write.text(path)


def load_assignment(base: DataFrame, path: str) -> DataFrame:
    """Attach saved cells to `base` by position; rows past the end of the file get cell 0. Ids must be 0, 1, 2, ..."""
    check_dense(base)
    lines = with_row_id(base.sparkSession.read.text(path), "id")
    cells = lines.select("id", F.trim("value").cast("double").cast("int").alias("cell"))
    return base.join(cells, "id", "left").withColumn("cell", F.coalesce("cell", F.lit(0)))


def save_model(path: str, assigned: DataFrame, fine: DataFrame, coarse: DataFrame) -> None:
    """The three files of a two-level clustering under one folder."""
    save_assignment(assigned, f"{path}/partition")
    save_centroids(coarse, f"{path}/centroids1")
    save_centroids(fine, f"{path}/centroids2")


def load_model(base: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base with its saved cell, fine centroids, coarse centroids).

    Attaching saved cells joins the base by id. Assigning cells anew from the saved fine centroids
    gives the same cells without moving the base.
    """
    spark = base.sparkSession
    return (
        load_assignment(base, f"{path}/partition"),
        load_centroids(spark, f"{path}/centroids2"),
        load_centroids(spark, f"{path}/centroids1"),
    )


def save_result(predictions: DataFrame, path: str) -> None:
    """Store predictions as Parquet in query order."""
    predictions.orderBy("qid").write.parquet(path)
