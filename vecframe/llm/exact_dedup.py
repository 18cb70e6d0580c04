"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries summary (Spark's `approx_top_k` family keeps such counters) names the few digests that may
be frequent. They are counted exactly, the verified winners are broadcast (at most `TRACKED` rows of one
digest, one id and one count), and their rows are settled where they are read. All other digests have
few rows each and take an ordinary shuffle.

Defined results: a null text is the empty text; null ids lose against any id; of rows equal in text and
id exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.llm.common import col, free_name, text_or_empty
from vecframe.session import write_and_read

# Counters of one summary; a digest with more than 4 rows in TRACKED is among them for certain.
TRACKED = 1024
# Summaries are merged in this many groups before one task merges the groups.
GROUPS = 64


def frequent_digests(digests: DataFrame, column: str = "digest", tracked: int = TRACKED) -> DataFrame:
    """Candidates for frequent values of a string column: one row each, at most `tracked` rows."""
    return (
        digests.select(col(column).alias("item"), (F.spark_partition_id() % GROUPS).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("sketch"))
        # Grouped by a constant: tasks without rows then give no (empty) summary, which could not be combined.
        .groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("top"))
        .select(F.col("top.item").alias("item"))
        .filter("item is not null")
    )


def verified_winners(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """digest, best (id and row of the one that stays), group_size of the frequent digests, counted exactly."""
    candidates = F.broadcast(frequent_digests(digests, tracked=tracked).withColumnRenamed("item", "digest"))
    return (
        digests.join(candidates, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256. Ids must be orderable."""
    rows = write_and_read(
        docs.select(
            col(id_col).alias("doc_id"),
            F.sha2(text_or_empty(text_col), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    winners = F.broadcast(write_and_read(verified_winners(rows, tracked), "winners"))
    frequent = rows.join(winners, "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    same = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select(
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.desc("doc_id"), F.desc("row"))) == 1).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return frequent.unionByName(rest)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, whole and with their columns: of equal texts the one with the largest id."""
    digest = free_name(docs, "digest")
    marked = docs.withColumn(digest, F.sha2(text_or_empty(text_col), 256))
    ids = marked.select(col(digest).alias("digest"), col(id_col).alias("doc_id"), F.lit(0).alias("row"))
    winners = write_and_read(verified_winners(write_and_read(ids, "digests"), tracked), "winners")
    best, rank = free_name(marked, "best"), free_name(marked, "rank")
    sent = winners.select(F.col("digest").alias(digest), F.struct(F.col("best.doc_id").alias("id")).alias(best))
    # Rows of frequent texts that lose go before the shuffle.
    light = marked.join(F.broadcast(sent), digest, "left").filter(
        col(best).isNull() | col(best)["id"].eqNullSafe(col(id_col))
    )
    order = Window.partitionBy(col(digest)).orderBy(col(id_col).desc())
    return light.withColumn(rank, F.row_number().over(order)).filter(col(rank) == 1).select(
        *[col(c) for c in docs.columns]
    )
