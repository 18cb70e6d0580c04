"""Packing fine cells into balanced partitions, and laying rows out by partition."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.operators.clustering import _centers
from vecframe.operators.kernel import TopK, squares, usable
from vecframe.session import free_name, ship, write_and_read


# Cells whose partitions fit an array literal in a plan.
_LITERAL_CELLS = 50_000


def pack(preference: list[Iterable[int]], sizes: list[int]) -> list[int]:
    """The bin of every cell. A preference may be a generator, which is read only as far as it is needed.

    Bins are served in turn. A bin that holds fewer rows than an even share (rounded down) takes
    the cell it ranks first among those still free; it may overshoot by that one cell. When a
    whole round passes with every bin full, or without a claim, each cell still free goes, in cell order, to the bin
    that holds the fewest rows (the lowest such bin).
    """
    n_bins = len(preference)
    share = sum(sizes) // n_bins
    bin_of: dict[int, int] = {}
    load = [0] * n_bins
    waiting = [iter(cells) for cells in preference]
    claimed = -1
    while claimed < len(bin_of) < len(sizes) and min(load) < share:
        claimed = len(bin_of)
        for b in (b for b in range(n_bins) if load[b] < share):
            cell = next((c for c in waiting[b] if c not in bin_of), None)
            if cell is not None:
                bin_of[cell] = b
                load[b] += sizes[cell]
    for cell in (c for c in range(len(sizes)) if c not in bin_of):
        b = load.index(min(load))
        bin_of[cell] = b
        load[b] += sizes[cell]
    return [bin_of[c] for c in range(len(sizes))]


def balance_cells(ranks: DataFrame, counts: DataFrame, config: str | None = None) -> DataFrame:
    """`part, cell, n` (and the `config` column): one packing per configuration.

    `ranks` is `coarse, cell, rank`, `counts` is `cell, n`. The greedy rule is sequential over
    the k1 x k2 rows of a model, never over data; a sweep packs its configurations in parallel.
    """
    ship(ranks.sparkSession)
    keys = [config] if config else []
    if not config:
        config = "_config"
        ranks, counts = ranks.withColumn(config, F.lit(0)), counts.withColumn(config, F.lit(0))
    rows = ranks.select(config, "coarse", "cell", "rank").join(
        counts.select(config, "cell", "n"), [config, "cell"]
    )
    dtype = dict(rows.dtypes)[config]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.groupby("cell")["n"].first().sort_index()
        ordered = pdf.sort_values(["coarse", "rank"])
        preference = [g["cell"].tolist() for _, g in ordered.groupby("coarse")]
        return pd.DataFrame({
            config: pdf[config].iloc[0],
            "part": pack(preference, sizes.tolist()),
            "cell": sizes.index,
            "n": sizes.to_numpy(),
        })

    packed = rows.groupBy(config).applyInPandas(one, f"{config} {dtype}, part int, cell int, n long")
    return packed.select(*keys, "part", "cell", "n")


def balance_near(
    coarse: DataFrame, fine: DataFrame, counts: DataFrame, metric: str = "cosine", first: int = 64
) -> DataFrame:
    """`part, cell, n` as `balance_cells` gives it from a full ranking, without one.

    A bin sees the `first` cells nearest to it, and four times as many each time it has looked at them all, so of
    k1 x k2 distances only rankings of the length that the packing needs are held. `counts` has every cell of `fine`.
    """
    anchors, cells = _centers(coarse), _centers(fine)
    if anchors is None or cells is None:
        raise ValueError("the centroids are too many to be packed on one machine")
    size = {r["cell"]: r["n"] for r in counts.select("cell", "n").collect()}
    numbers, centers = cells
    sizes = [size[c] for c in numbers.tolist()]
    place = np.arange(len(numbers))
    # Cells without a distance come last, in order.
    apart = place[~usable(squares(centers), metric)]

    def nearest_first(anchor):
        m, seen = first, 0
        while True:
            lists = TopK(np.zeros(1), anchor[None], m, metric)
            lists.update(None, place, centers)
            found = lists.result()[1]
            yield from found[seen:].tolist()
            if len(found) < m:
                # All that have a distance were seen. A zero anchor has a distance to none.
                yield from apart.tolist() if len(found) else place.tolist()
                return
            m, seen = 4 * m, len(found)

    packed = pack([nearest_first(a) for a in anchors[1]], sizes)
    rows = pa.table({
        "part": pa.array(packed, pa.int32()), "cell": pa.array(numbers, pa.int32()), "n": pa.array(sizes, pa.int64())
    })
    return fine.sparkSession.createDataFrame(rows, "part int, cell int, n long")


def cell_to_part(packed: DataFrame, n_cells: int) -> DataFrame:
    """`cell, part` for every cell 0..n_cells-1; a cell that no bin took belongs to bin 0."""
    cells = packed.sparkSession.range(n_cells).select(F.col("id").cast("int").alias("cell"))
    return cells.join(packed.select("cell", "part"), "cell", "left").withColumn(
        "part", F.coalesce("part", F.lit(0))
    )


def remap_cells(df: DataFrame, cell_map: DataFrame, cell: str = "cell", part: str = "part") -> DataFrame:
    """Add the partition of each row's cell.

    The map becomes an array literal, so `part` is an expression of `cell`: on a table stored by
    cell, a condition on `part` selects folders. A map too large for that is joined.
    """
    parts = _as_literal(cell_map)
    if parts is not None:
        return df.withColumn(part, F.get(parts, F.col(cell)))
    lookup = cell_map.select(F.col("cell").alias("_cell"), F.col("part").alias(part))
    return df.join(lookup, F.col(cell) == F.col("_cell"), "left").drop("_cell")


def remap_cell_lists(df: DataFrame, cell_map: DataFrame, column: str, out: str) -> DataFrame:
    """Map every cell in an array column to its partition, keeping order and repetitions.

    A cell that the map lacks becomes null. A map too large for an array literal is joined.
    """
    parts = _as_literal(cell_map)
    if parts is not None:
        return df.withColumn(out, F.transform(column, lambda c: F.get(parts, c)))
    row = free_name(df, "_row")
    rows = write_and_read(df.withColumn(row, F.monotonically_increasing_id()), "unmapped")
    cells = rows.select(F.col(row).alias("row"), F.posexplode(column).alias("pos", "cell"))
    lookup = cell_map.select("cell", "part")
    lists = cells.join(lookup, "cell", "left").groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]).alias("parts")
    )
    parts = free_name(rows, "_parts")
    lists = lists.select(F.col("row").alias(row), F.col("parts").alias(parts))
    none = F.when(F.col(column).isNotNull(), F.array().cast("array<int>"))
    return rows.join(lists, row, "left").withColumn(out, F.coalesce(parts, none)).drop(row, parts)


def _as_literal(cell_map: DataFrame):
    """The partitions of cells 0, 1, 2, ... as a constant array, if the map is dense and small."""
    rows = cell_map.select("cell", "part").limit(_LITERAL_CELLS + 1).collect()
    part_of = {r["cell"]: r["part"] for r in rows}
    if not rows or len(rows) > _LITERAL_CELLS or sorted(part_of) != list(range(len(rows))):
        return None
    listed = ",".join(str(part_of[c]) for c in range(len(rows)))
    return F.split(F.lit(listed), ",").cast("array<int>")


def write_by_cell(df: DataFrame, path: str, cell: str = "cell") -> DataFrame:
    """Store rows by cell (one folder each) and read them back.

    Rebalancing lets adaptive execution split a cell that is too large for one task and join
    small ones, so a hot cell becomes several files, not one long task.
    """
    placed = df.hint("rebalance", F.col(cell)).write.partitionBy(cell)
    # Components hardly repeat, so a dictionary of them costs time and saves nothing. Short row
    # groups let a search split a cell over more tasks.
    placed.option("parquet.enable.dictionary", "false").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repartition_by_part(df: DataFrame, part: str = "part") -> DataFrame:
    """Place the rows of a partition together, oversized partitions split by adaptive execution."""
    return df.hint("rebalance", F.col(part))


def part_sizes(df: DataFrame, n_parts: int, part: str = "part", weight: str | None = None) -> DataFrame:
    """`part, n` for every partition, empty ones included; `weight` sums a column instead of rows."""
    parts = df.sparkSession.range(n_parts).select(F.col("id").cast("int").alias("part"))
    size = F.sum(weight) if weight else F.count("*")
    counted = df.groupBy(F.col(part).alias("part")).agg(size.alias("n"))
    return parts.join(counted, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
