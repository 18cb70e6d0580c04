"""Quality of a search result against ground truth, and how neighbours spread over partitions.

Results and truth are tables `qid, neighbors array<long>`, nearest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.operators.knn import ranked_distance
from vecframe.session import RESULT_ROWS, model_table


def neighbor_lists(neighbors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`qid, neighbors` from exploded rows `qid, neighbor, rank`."""
    pair = F.struct("rank", "neighbor")
    return neighbors.groupBy(*(keys or ["qid"])).agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["neighbor"]).alias("neighbors")
    )


def _paired(predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Every query of the truth with its first k true ids and what was found for it."""
    real = truth.select("qid", F.slice("neighbors", 1, k).alias("real"))
    found = predicted.select("qid", F.col("neighbors").alias("found"))
    return real.join(found, "qid", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<long>"))
    )


def recall_at_k(predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row `k, queries, recall`: shared ids / (queries * k), also where lists are short."""
    hit = F.size(F.array_intersect("found", "real"))
    return _paired(predicted, truth, k).agg(
        F.lit(k).alias("k"),
        F.count("*").alias("queries"),
        (F.sum(hit) / (F.count("*") * F.lit(k))).alias("recall"),
    )


def positional_match(predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row `k, match_rate`: the share of the k positions that hold the same id in both."""
    same = F.zip_with(
        F.slice("found", 1, k), F.col("real"),
        lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(0)),
    )
    count = F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    return _paired(predicted, truth, k).agg(
        F.lit(k).alias("k"), (F.sum(count) / (F.count("*") * F.lit(k))).alias("match_rate")
    )


def recall_first_nn(predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """`at, recall` for at = 1, 10, 100, ... up to k: true nearest id within the first `at`."""
    depths = []
    at = 1
    while at <= k:
        depths.append(at)
        at *= 10
    pairs = _paired(predicted, truth, 1)
    hits = [
        F.avg(F.when(F.array_contains(F.slice("found", 1, at), F.get("real", F.lit(0))), 1.0).otherwise(0.0))
        for at in depths
    ]
    rows = F.array(*[F.struct(F.lit(at).alias("at"), hit.alias("recall")) for at, hit in zip(depths, hits)])
    return pairs.agg(rows.alias("rows")).select(F.inline("rows"))


def partition_coverage(truth: DataFrame, parts: DataFrame, n_parts: int, k: int) -> DataFrame:
    """`rank, nonzero, neighbors, share` for rank 1..n_parts.

    A query's k true neighbours are counted per partition (`parts` is `id, part`) and the counts
    sorted ascending, empty partitions first. Per rank: the queries with any neighbour there, the
    neighbours in total, and their share of queries * k. Empty partitions are never materialised:
    a query's non-empty counts simply take its last ranks.
    """
    exploded = truth.select("qid", F.explode(F.slice("neighbors", 1, k)).alias("id"))
    exploded = model_table(exploded, RESULT_ROWS)  # so that `parts`, as long as the base, stays put
    counted = exploded.join(parts.select("id", "part"), "id").groupBy("qid", "part").agg(
        F.count("*").alias("n")
    )
    per_query = counted.groupBy("qid").agg(F.array_sort(F.collect_list("n")).alias("counts"))
    placed = per_query.select(
        F.size("counts").alias("filled"), F.posexplode("counts").alias("pos", "n")
    ).withColumn("rank", F.lit(n_parts) - F.col("filled") + F.col("pos") + 1)
    total = placed.groupBy("rank").agg(F.count("*").alias("nonzero"), F.sum("n").alias("neighbors"))
    ranks = truth.sparkSession.range(1, n_parts + 1).select(F.col("id").cast("int").alias("rank"))
    queries = truth.agg(F.count("*").alias("queries"))
    dense = ranks.join(total, "rank", "left").select(
        "rank",
        F.coalesce("nonzero", F.lit(0)).alias("nonzero"),
        F.coalesce("neighbors", F.lit(0)).alias("neighbors"),
    )
    n_queries = queries.first()["queries"]
    return dense.withColumn("share", F.col("neighbors") / F.lit(float(max(n_queries, 1) * k)))


def sweep_recall(
    per_part: DataFrame, routed: DataFrame, part_rows: DataFrame, truth: DataFrame,
    ks: list[int], probe_counts: list[int],
) -> DataFrame:
    """`k, probes, recall, candidates` for every setting, from one search.

    `per_part` holds the max(ks) nearest rows per (query, probed partition) of a search with the
    longest probe lists. Shorter lists are prefixes of the long ones, so every setting is a
    filter on the probe position, a re-ranking, and a cut at k. `candidates` counts the base rows
    a setting compares in all.
    """
    position = routed.select("qid", F.posexplode("probes").alias("position", "part"))
    grid = F.explode(F.array(*[F.lit(p) for p in sorted(set(probe_counts))])).alias("probes")
    depth = Window.partitionBy("qid", "probes").orderBy(ranked_distance(), "neighbor")
    ranked = (
        per_part.drop("rank")
        .join(position, ["qid", "part"])
        .select("*", grid)
        .where("position < probes")
        .withColumn("rank", F.row_number().over(depth))
        .where(F.col("rank") <= max(ks))
    )
    real = truth.select("qid", F.posexplode(F.slice("neighbors", 1, max(ks))).alias("true_pos", "neighbor"))
    hits = ranked.join(real, ["qid", "neighbor"])
    n_queries = truth.count()
    recalls = hits.groupBy("probes").agg(*[
        F.count_if((F.col("rank") <= k) & (F.col("true_pos") < k)).alias(f"hits_{k}") for k in ks
    ])
    candidates = (
        position.select("part", "position", grid).where("position < probes")
        .groupBy("probes", "part").agg(F.count("*").alias("asked"))
        .join(part_rows.select("part", "n"), "part")
        .groupBy("probes").agg(F.sum(F.col("asked") * F.col("n")).alias("candidates"))
    )
    by_k = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits")) for k in ks])
    return (
        candidates.join(recalls, "probes", "left")
        .select("probes", "candidates", F.inline(by_k))
        .select(
            "k", "probes",
            (F.coalesce("hits", F.lit(0)) / (F.lit(n_queries) * F.col("k"))).alias("recall"),
            "candidates",
        )
    )
