"""Training prefix and the two samplers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.session import model_table

# Rows of one cell that may be ranked exactly in one task when a sample is cut.
_RANKED_ROWS = 200_000


def train_prefix(df: DataFrame, rate: float, id_col: str = "id") -> DataFrame:
    """The first int(rows * rate) rows in the order of their ids, which may have gaps, or start anywhere.

    Where ids are repeated, all rows of the last id come along. Rows without an id are in no prefix and not counted.
    The last id is found by counts alone, without sorting; on Parquet the id filter reaches the scan.
    """
    rows, least, most = df.agg(F.count(id_col), F.min(id_col), F.max(id_col)).first()
    wanted = int(rows * rate)
    if wanted == 0:
        return df.limit(0)
    return df.where(F.col(id_col) <= nth_id(df, wanted, least, most, id_col))


def nth_id(df: DataFrame, n: int, least: int, most: int, id_col: str = "id", buckets: int = 4096) -> int:
    """The n-th smallest of the ids (n from 1), which lie between `least` and `most`.

    Ids without gaps are recognized by one count. Otherwise a histogram of equal steps between the two ends finds the
    step that holds the n-th id, and the next one looks inside; 64-bit ids take six of them at most.
    """
    id_ = F.col(id_col)
    guess = least + n - 1
    below, upto = df.agg(F.count_if(id_ < guess), F.count_if(id_ <= guess)).first()
    if below < n <= upto:
        return guess
    while least < most:
        step = -(-(most - least + 1) // buckets)
        # The distance from the lowest id may pass the range of a long.
        gap = id_.cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")
        at = F.call_function("div", gap, F.lit(step).cast("decimal(20,0)"))
        inside = df.where(id_.between(least, most)).groupBy(at.alias("at")).count()
        # At most `buckets` rows.
        for row in sorted(inside.collect()):
            if n <= row["count"]:
                break
            n -= row["count"]
        least, most = least + row["at"] * step, min(most, least + (row["at"] + 1) * step - 1)
    return least


def sample_per_cell(
    df: DataFrame,
    rate: float,
    cell: str = "cell",
    id_col: str = "id",
    seed: int = 42,
    ranked_rows: int = _RANKED_ROWS,
) -> DataFrame:
    """Exactly round-half-even(rows * rate) rows of every cell, the same ones on every run.

    A cell keeps its rows of smallest (md5("id:seed"), id). A large cell is never sorted: a
    histogram over leading digits of the hash finds the slice that holds the cell's last sampled
    row, and only that slice (`ranked_rows` rows or so) is ranked. The rows are then taken by one
    filter on the cut value, which alone reads vectors.
    """
    hashed = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    slim = df.select(F.col(cell).alias("cell"), F.col(id_col).alias("id"), hashed.alias("hash"))

    quota = model_table(
        slim.groupBy("cell").agg(F.count("*").alias("rows"))
        .select("cell", "rows", F.bround(F.col("rows") * rate).cast("long").alias("quota"))
        .where("quota > 0")
    )
    largest = quota.agg(F.max("rows")).first()[0]
    if largest is None:
        return df.limit(0)
    digits = math.ceil(math.log(max(largest / ranked_rows, 1), 16))
    if digits == 0:  # every cell is small enough to be ranked whole
        cut_slice = quota.select("cell", F.lit("").alias("slice"), F.col("quota").alias("left"))
    else:
        cut_slice = _cut_slices(slim, quota, digits)
    order = Window.partitionBy("cell").orderBy("hash", "id")
    last = model_table(
        slim.join(cut_slice, "cell")
        .where(F.substring("hash", 1, digits) == F.col("slice"))
        .withColumn("place", F.row_number().over(order))
        .where("place = left")
        .select(F.col("cell").alias("_cell"), F.col("hash").alias("_hash"), F.col("id").alias("_id"))
    )
    inside = (hashed < F.col("_hash")) | ((hashed == F.col("_hash")) & (F.col(id_col) <= F.col("_id")))
    return df.join(last, F.col(cell) == F.col("_cell")).where(inside).select(*[F.col(c) for c in df.columns])


def _cut_slices(slim: DataFrame, quota: DataFrame, digits: int) -> DataFrame:
    """Per cell, the hash slice in which its quota is reached, and how many rows to take of it."""
    counted = (
        slim.withColumn("slice", F.substring("hash", 1, digits))
        .groupBy("cell", "slice").agg(F.count("*").alias("in_slice"))
    )
    upto = Window.partitionBy("cell").orderBy("slice")
    return model_table(
        counted.withColumn("upto", F.sum("in_slice").over(upto))
        .join(quota, "cell")
        .where("upto >= quota and upto - in_slice < quota")
        .select("cell", "slice", F.expr("quota - (upto - in_slice)").alias("left"))
    )


def stratum_fractions(df: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """One row for each distinct value of a column, null included, with a constant `fraction`."""
    return df.select(stratum).distinct().withColumn("fraction", F.lit(float(fraction)))


def sample_bernoulli(
    df: DataFrame, fraction: float, id_col: str = "id", seed: int = 42, stratum: str | None = None,
    fractions: DataFrame | None = None,
) -> DataFrame:
    """Keep each row with the given probability, in every stratum alike unless `fractions` says otherwise.

    `fractions` (of `stratum_fractions`, or any table of the `stratum` column and `fraction`) gives strata a
    probability of their own; `fraction` holds for those it lacks. It is sent to the rows while it is of model
    size and joined by shuffle beyond. A hash of seed and id decides, so the sample does not depend on how the
    rows are laid out, and a higher fraction keeps the rows of a lower one.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    if fractions is None:
        return df.filter(draw < int(fraction * 2**32))
    if stratum is None:
        raise ValueError("fractions need the name of their stratum column")
    name, share = "_stratum", "_fraction"
    while {name, share} & {c.lower() for c in df.columns}:
        name, share = f"_{name}", f"_{share}"
    # Of a stratum that is named twice, the higher fraction holds; the rows are not doubled.
    own = fractions.groupBy(F.col(stratum).alias(name)).agg(F.max("fraction").cast("double").alias(share))
    joined = df.join(model_table(own), F.col(stratum).eqNullSafe(F.col(name)), "left")
    limit = F.floor(F.coalesce(F.col(share), F.lit(float(fraction))) * 2**32)
    return joined.filter(draw < limit).select(*[F.col(f"`{c}`") for c in df.columns])
