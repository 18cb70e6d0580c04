"""Exact search over rows that lie in cells: cells that cannot hold a neighbour are not read.

Every cell has a radius, the largest distance of its rows from its centroid. By the triangle inequality no row of
a cell is nearer to a query than the distance of the query and the centroid less the radius. A query searches its
most promising cells first, and then, in rounds of growing size, those whose least distance does not exceed the
k-th distance found so far; when no such cell is left, its list is exact. Cosine distances are compared as angles,
which obey the inequality where the distances do not; inner products have no such form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.functions.distance import cosine_distance, l2_distance
from vecframe.operators.kernel import _TIE, list_matrix
from vecframe.operators.knn import Limits, knn_join, topk_per_query
from vecframe.session import model_table, ship, write_and_read

# A round searches so many times the cells of the round before it.
_GROWTH = 4
# Pairs of queries and cells that are weighed at once.
_PAIRS = 4_000_000
# Cells that may be sent to every task, and bytes of their centroids.
_CELLS, _CELL_BYTES = 50_000, 64 << 20
# What rounding may add to a distance, of its size.
_ROUNDING = 1e-6


def cell_radii(base: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """`cell, radius, n` of every cell that rows lie in: the largest distance (an angle under cosine) and the rows.

    A cell whose centroid is missing or has no distance gets no radius (null) and is never left out of a search.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("cells have radii for l2 and cosine only")
    center = model_table(centroids.select(F.col("cell").alias("_cell"), F.col("centroid").alias("_centroid")))
    rows = base.select("cell", "features").join(center, F.col("cell") == F.col("_cell"), "left")
    if metric == "l2":
        distance = l2_distance("features", "_centroid")
    else:
        apart = cosine_distance("features", "_centroid")
        distance = F.acos(F.when(apart.isNotNull(), F.greatest(F.lit(-1.0), 1 - apart)))  # greatest skips nulls
    # Rows without a distance are nobody's neighbours and have no say, unless it is the centroid that lacks one.
    fine = F.when(F.isnan(distance) | (distance == float("inf")), None).otherwise(distance)
    found = rows.groupBy("cell").agg(F.max(fine).alias("radius"), F.count("*").alias("n"))
    return found.select(F.col("cell").cast("int").alias("cell"), "radius", "n")


def _next_cells(state: DataFrame, model, metric: str, step: int) -> DataFrame:
    """Queries that are not settled, with the cells they search next."""
    cells, centers, radius = model
    shared = state.sparkSession.sparkContext.broadcast((cells, centers, radius))

    def run(batches):
        cells, centers, radius = shared.value
        for batch in batches:
            tile = max(1, _PAIRS // max(1, len(cells)))
            for start in range(0, batch.num_rows, tile):
                yield from chosen(batch.slice(start, tile), cells, centers, radius)

    def chosen(batch, cells, centers, radius):
        vectors = list_matrix(batch.column("features")).astype(np.float64)
        searched = batch.column("searched").to_numpy()
        bound = batch.column("bound").to_numpy(zero_copy_only=False)
        near = _distances(vectors, centers, metric)
        least = np.maximum(near * (1 - _ROUNDING) - radius * (1 + _ROUNDING) - _ROUNDING * 0.1, 0.0)
        least = np.where(np.isnan(least), 0.0, least)
        order = np.lexsort((np.broadcast_to(cells, least.shape), np.nan_to_num(near), least), axis=1)
        least = np.take_along_axis(least, order, axis=1)
        if metric == "cosine":
            least = 1 - np.cos(np.minimum(least, np.pi))
        place = np.arange(len(cells))
        # Cells are in order of their least distance, so those searched before are a prefix.
        wanted = (place >= searched[:, None]) & (place < searched[:, None] + step) & (least <= bound[:, None] + _TIE)
        n = wanted.sum(axis=1)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32), pa.array(cells[order[wanted]].astype(np.int32))
        )
        taken = batch.take(pa.array(some))
        yield pa.RecordBatch.from_pydict({
            "qid": taken.column("qid"), "features": taken.column("features"), "searched": searched[some] + n[some],
            "bound": taken.column("bound"), "cells": lists,
        })

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    return state.mapInArrow(run, f"{schema}, cells array<int>")


def _distances(vectors, centers, metric):
    """Distances (angles under cosine) of all pairs; NaN where there is none."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "cosine":
            a = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            b = centers / np.linalg.norm(centers, axis=1, keepdims=True)
            return np.arccos(np.clip(a @ b.T, -1, 1))
        out = np.empty((len(vectors), len(centers)))
        for j, c in enumerate(centers):
            out[:, j] = np.sqrt(((vectors - c) ** 2).sum(axis=1))
        return out


def knn_cells_exact(
    queries: DataFrame,
    base: DataFrame,
    centroids: DataFrame,
    k: int,
    metric: str = "l2",
    radii: DataFrame | None = None,
    first_cells: int = 2,
    strategy: str = "auto",
    limits: Limits = Limits(),
    exclude_self: bool = False,
    with_cells: bool = False,
):
    """The k nearest rows of the whole base: `qid, neighbor, distance, rank`, equal to `knn_join` without probes.

    `base` (`id, features, cell`) is best stored by cell. `radii` (of `cell_radii`, for the cells of this base) are
    found if not given; rows whose cell is null are then a cell without a radius, which is always searched. With `with_cells`, the result comes with a
    second table, `qid, cells`: how many cells each query had to search.
    """
    spark = ship(queries.sparkSession)
    base = base.select("id", "features", F.coalesce(F.col("cell").cast("int"), F.lit(-1)).alias("cell"))
    if radii is None:
        radii = cell_radii(base, centroids, metric)
    model = _model(radii, centroids)
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "features").where("features is not null")
    join = {"metric": metric, "exclude_self": exclude_self, "strategy": strategy, "limits": limits}
    if model is None:  # more cells than a task can weigh
        found = knn_join(asked, base, k, **join)
        return (found, asked.select("qid", F.lit(None).cast("long").alias("cells"))) if with_cells else found
    state = asked.select("qid", "features", F.lit(0).cast("long").alias("searched"), F.lit(float("inf")).alias("bound"))
    lists, searched, step = None, [], first_cells
    while True:
        turn = write_and_read(_next_cells(state, model, metric, step), "cells-to-search")
        if turn.isEmpty():
            break
        searched.append(turn.select("qid", "searched"))
        found = knn_join(turn, base, k, probes="cells", part="cell", bound="bound", clustered=True, **join)
        lists = found if lists is None else topk_per_query(lists.drop("rank").unionByName(found.drop("rank")), k)
        lists = write_and_read(lists.withColumn("rank", F.col("rank").cast("int")), "lists")
        bounds = lists.where(F.col("rank") == k).select("qid", F.col("distance").alias("bound"))
        state = turn.drop("bound", "cells").join(bounds, "qid", "left").select(
            "qid", "features", "searched", F.coalesce("bound", F.lit(float("inf"))).alias("bound")
        )
        step *= _GROWTH
    if lists is None:
        lists = spark.createDataFrame([], "qid long, neighbor long, distance double, rank int")
    if not with_cells:
        return lists
    total = spark.createDataFrame([], "qid long, searched long")
    for turn in searched:
        total = total.unionByName(turn)
    return lists, total.groupBy("qid").agg(F.max("searched").alias("cells"))


def _model(radii: DataFrame, centroids: DataFrame):
    """(cells, centroids, radii) of the cells that hold rows, if they are few enough to be sent around."""
    held = radii.limit(_CELLS + 1).toArrow()
    if held.num_rows > _CELLS:
        return None
    n, values = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n > _CELLS or 8 * n * (values or 0) > _CELL_BYTES:
        return None
    center = {r["cell"]: r["centroid"] for r in centroids.collect()}
    cells = held.column("cell").to_numpy()
    centers = np.array([center.get(c) or [np.nan] * (values or 0) for c in cells.tolist()], dtype=np.float64)
    radius = held.column("radius").to_numpy().astype(np.float64)
    return cells, centers.reshape(len(cells), -1), np.where(np.isnan(radius), np.inf, radius)
