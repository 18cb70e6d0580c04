"""Minimax contiguous sharding of documents, with equal texts kept together.

Groups of equal texts are atomic; the few large ones come first in order, by size, the others by digest.
The smallest capacity for which a greedy pass needs no more shards than given is found by binary search,
and the shards are cut there. A group above an even share of what is left gets a shard of its own; it
bounds the capacity anyway, and the others then share evenly.

The search sees sums of digest ranges, not groups. Where a cut can fall for any capacity still possible,
the ranges are split finer by one Spark job a round, until those ranges hold at most `EXACT_GROUPS`
groups; these are fetched and the answer is exact. What reaches the driver has that bound.

Defined results: a null text has size 1 and is a group of its own kind with the empty text (both have no
bytes); an empty table gives no rows; repeated rows are rows of their own and stay together.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.llm.common import col, text_or_empty
from vecframe.session import write_and_read

SHARDS = 16
# Digest ranges by this many hex digits at first, and this many more in each finer round.
FIRST_DIGITS, MORE_DIGITS = 3, 2
# Groups of at least this part of all bytes are placed first, the largest before the others; they are as many at most.
LARGE = 1024
# Groups fetched for the exact end of the search (a 64 digit key and a number each).
EXACT_GROUPS = 100_000


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """First position of every shard but the first, when shards are filled in order up to `capacity`."""
    sums = list(accumulate(sizes, initial=0))
    cuts, at = [], 0
    while (at := bisect_right(sums, sums[at] + capacity) - 1) < len(sizes):
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which `greedy_cuts` makes at most `shards` shards."""
    low, high = max([1, -(-sum(sizes) // shards), *sizes]), max(1, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _open_ranges(units: list[tuple], shards: int) -> list[str]:
    """Prefixes of the ranges in which a cut can fall, of (prefix, size, groups) in order."""
    sizes = [u[1] for u in units]
    sums = list(accumulate(sizes, initial=0))
    least, most = -(-sums[-1] // shards), smallest_capacity(sizes, shards)
    wanted, low = set(), 0
    for j in range(1, shards):
        # The j-th cut lies above what whole ranges alone allow with the least capacity, and below j full shards.
        low = max(low, bisect_right(sums, sums[low] + least) - 1)
        high = bisect_right(sums, min(j * most, sums[-1]))
        wanted.update(range(low, min(high, len(units))))
    return [units[i][0] for i in sorted(wanted) if units[i][2] > 1]


def _fetch(groups: DataFrame, digits: int, inside: list[str]) -> list[tuple]:
    """(prefix, size, groups) of the ranges of `digits` hex digits that lie in the given shorter ones."""
    prefix = F.substring("digest", 1, digits)
    if inside:
        groups = groups.filter(F.substring("digest", 1, len(inside[0])).isin(inside))
    rows = groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return sorted((r["prefix"], r["size"], r["n"]) for r in rows.collect())


def minimax_cuts(
    groups: DataFrame, shards: int, exact_groups: int = EXACT_GROUPS
) -> tuple[list[tuple[str, int]], int, list[str]]:
    """(large digests with their shards, shard of the first other digest, first digests of the shards after it).

    `groups` has digest (hex) and size (long), one row per digest.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    # At most LARGE groups reach a LARGE-th part of all.
    found = groups.filter(F.col("size") * LARGE >= total).orderBy(F.desc("size"), "digest").collect() if total else []
    alone = []
    for r in found:
        left = shards - len(alone)
        if left == 1 or r["size"] * left <= total:
            break
        alone.append((r["digest"], left - 1))
        total -= r["size"]
    large = [(r["digest"], r["size"]) for r in found[len(alone):]]
    rest = groups.join(F.broadcast(_table(groups, [(r["digest"], 0) for r in found])), "digest", "left_anti")
    shards -= len(alone)
    first = [("", size, 1) for _, size in large]
    digits = FIRST_DIGITS
    units = first + _fetch(rest, digits, [])
    while shards > 1 and digits < 64:
        held = {u[0]: u[2] for u in units}
        deep = {p for p in _open_ranges(units, shards) if len(p) == digits}
        if not deep:
            break
        exact = sum(held[p] for p in deep) <= exact_groups
        digits_now, digits = digits, 64 if exact else min(64, digits + MORE_DIGITS)
        ranges = [u for u in units[len(first):] if u[0] not in deep]
        units = first + sorted(ranges + _fetch(rest, digits, sorted(deep)))
        assert digits > digits_now
    sizes = [u[1] for u in units]
    cuts = greedy_cuts(sizes, smallest_capacity(sizes, shards)) if units else []
    placed = alone + [(large[i][0], bisect_right(cuts, i)) for i in range(len(large))]
    return placed, bisect_right(cuts, len(large)), [units[i][0] for i in cuts if i > len(large)]


def _table(df: DataFrame, pairs: list[tuple[str, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame(pairs, "digest string, large_shard int")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    exact_groups: int = EXACT_GROUPS,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`; slots are gapless from 0 in a shard."""
    text = text_or_empty(text_col)
    rows = write_and_read(
        docs.select(
            col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    groups = write_and_read(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    large, first, boundaries = minimax_cuts(groups, shards, exact_groups)
    later = sum((F.when(F.col("digest") >= b, 1).otherwise(0) for b in boundaries), F.lit(first))
    placed = (
        rows.join(F.broadcast(_table(rows, large)), "digest", "left")
        .withColumn("shard", F.coalesce("large_shard", later).cast("int"))
        .withColumn("task", F.shiftright("row", 33))
    )
    # A row's slot: rows of its shard in earlier tasks, and earlier rows in its own task. Tasks bound the groups.
    counts = placed.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "task").orderBy("row")
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(offsets, ["shard", "task"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))
    )
