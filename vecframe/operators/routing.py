"""Choosing the partitions a query is searched in, from its neighbours in a small sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.functions.arrays import refill, truncate_vector, unique_refill
from vecframe.operators.knn import Limits, knn_join, ranked_distance

PROBE_ORDERS = ("id", "distance")


def route_queries(
    queries: DataFrame,
    sample: DataFrame,
    n_parts: int,
    n_probes: int,
    neighbors: int = 30,
    metric: str = "cosine",
    probe_order: str = "id",
    truncate: bool = False,
    bound_k: int | None = None,
    bound_probes: int | None = None,
    cells: str | None = None,
    strategy: str = "auto",
    limits: Limits = Limits(),
) -> DataFrame:
    """`queries` with `probes`: exactly min(n_probes, n_parts) partitions to search.

    The `neighbors` nearest rows of `sample` (`id, features, part`) name the partitions. With
    ``probe_order="id"`` the lowest partition ids among them are kept, with ``"distance"`` those
    whose best sample row is nearest. Missing ones are filled with the lowest unused ids.
    `truncate` drops the fractions of the sample vectors first. With `bound_k`, a column `bound`
    is added: the distance of the query's bound_k-th nearest sample row that lies in one of its
    probed partitions (of the first `bound_probes` if given). Sample rows are base rows, so no true
    bound_k-th neighbour is farther.
    `cells` names a query column with the fine cells whose sample rows are looked at; without it
    the whole sample is, which grows with the base.
    """
    if probe_order not in PROBE_ORDERS:
        raise ValueError(f"probe_order must be one of {PROBE_ORDERS}")
    if truncate:
        sample = sample.withColumn("features", truncate_vector("features").cast("array<double>"))
    hits = knn_join(
        queries, sample, neighbors, metric,
        probes=cells, part="cell", carry="part", strategy=strategy, limits=limits,
    )
    hit = F.struct(ranked_distance().alias("distance"), F.col("tag").cast("int").alias("part"))
    best = hits.groupBy("qid").agg(F.collect_list(hit).alias("hits"))
    parts = F.transform(F.array_sort("hits"), lambda h: h["part"])
    if probe_order == "distance":
        probes = refill(F.array_distinct(parts), n_probes, n_parts)
    else:
        probes = unique_refill(parts, n_probes, n_parts)
    routed = best.withColumn("probes", probes)
    columns = ["qid", "probes"]
    if bound_k is not None and not truncate:
        asked = F.col("probes") if bound_probes is None else F.slice("probes", 1, bound_probes)
        inside = F.filter("hits", lambda h: F.array_contains(asked, h["part"]))
        routed = routed.withColumn(
            "bound", F.get(F.transform(F.array_sort(inside), lambda h: h["distance"]), F.lit(bound_k - 1))
        )
        columns.append("bound")
    # A query without any distance (a zero vector) still gets its full list of partitions.
    nothing = refill(F.array().cast("array<int>"), n_probes, n_parts)
    return queries.join(routed.select(*columns), "qid", "left").withColumn(
        "probes", F.coalesce("probes", nothing)
    )
