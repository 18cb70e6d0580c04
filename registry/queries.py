"""One query per operator, each over the whole `embeddings` table.

The table plays every role: all rows are base vectors and all rows are queries. Fine cells start
from the mean vector of each label, coarse ones from the means of label groups, and both go
through two Lloyd steps, so that every result is determined and can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.settings import (
    FINE,
    GROUPS,
    K,
    LLOYD_STEPS,
    NEIGHBORS,
    PARTS,
    PROBES,
    RATE,
    SWEEP_K,
    SWEEP_PROBES,
)
from vecframe.functions.arrays import max_normalize, truncate_vector, unique_refill
from vecframe.functions.distance import cosine_distance, ip_distance, l2_distance
from vecframe.operators import clustering as cl
from vecframe.operators import evaluate as ev
from vecframe.operators import knn, packing, routing, sampling
from vecframe.operators.exact_cells import knn_cells_exact
from vecframe.operators.spectrum import frame_spectrum
from vecframe.plans import search as plan
from vecframe.session import fresh_path, model_table, write_and_read
from vecframe.sources import tables, vecs

CONFIG = plan.SearchConfig(
    k=K, n_parts=PARTS, n_probes=PROBES, sample_rate=RATE, route_neighbors=NEIGHBORS
)


SCHEMA = "vec_id long, embedding array<float>, label int"


def base(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select(F.col("id").alias("qid"), "features")


def probing(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that search two given labels."""
    labels = F.array(F.col("label"), F.pmod(F.col("label") + 3, F.lit(FINE)))
    return base(spark, sf).select(F.col("id").alias("qid"), "features", labels.alias("probes"))


def label_means(spark, sf):
    return model_table(cl.mean_vectors(base(spark, sf), "label"))


def fine_cells(spark, sf):
    return cl.kmeans_lloyd(base(spark, sf), label_means(spark, sf), LLOYD_STEPS)


def coarse_cells(spark, sf, groups=GROUPS):
    grouped = base(spark, sf).withColumn("group", F.col("label") % groups)
    start = model_table(cl.mean_vectors(grouped, "group"))
    return cl.kmeans_lloyd(base(spark, sf), start, LLOYD_STEPS)


def assigned(spark, sf):
    return cl.assign_cells(base(spark, sf), fine_cells(spark, sf))


def packed(spark, sf):
    fine = fine_cells(spark, sf)
    counts = cl.cell_counts(cl.assign_cells(base(spark, sf), fine), FINE)
    return packing.balance_cells(cl.rank_cells(coarse_cells(spark, sf), fine), counts)


def cell_map(spark, sf):
    return model_table(packing.cell_to_part(packed(spark, sf), FINE))


def index(spark, sf, config=CONFIG):
    return plan.build_index(base(spark, sf), config, fine_cells(spark, sf), coarse_cells(spark, sf))


def truth(spark, sf):
    """Exact neighbour lists, stored because several readers share them."""
    found = plan.exact_search(base(spark, sf).drop("label"), asked(spark, sf), CONFIG)
    return write_and_read(ev.neighbor_lists(found), "truth")


def predicted(spark, sf):
    """Neighbour lists of the search in two given labels."""
    return ev.neighbor_lists(
        knn.knn_join(probing(spark, sf), base(spark, sf), K, probes="probes", part="label")
    )


# Shapes that a value comparison can read: rows instead of lists, fixed decimals.


def shown(neighbors: DataFrame, *extra: str) -> DataFrame:
    return neighbors.select(
        "qid", *extra, "neighbor", F.round("distance", 6).alias("distance"), F.col("rank").cast("int")
    )


def values(df: DataFrame, key: str, column: str, out: str = "value") -> DataFrame:
    rows = df.select(key, F.posexplode(column).alias("pos", "item"))
    dtype = dict(df.dtypes)[column]
    item = F.col("item")
    if "float" in dtype or "double" in dtype:
        item = F.round(item.cast("double"), 6) + F.lit(0.0)
    return rows.select(key, "pos", item.alias(out))


# Functions


def _distance(fn):
    def query(spark, sf):
        rows = base(spark, sf).join(label_means(spark, sf), F.col("label") == F.col("cell"))
        return rows.select("id", F.round(fn("features", "centroid"), 6).alias("distance"))

    return query


def q_max_normalize(spark, sf):
    return values(base(spark, sf).select("id", max_normalize("features").alias("v")), "id", "v")


def q_truncate_vectors(spark, sf):
    scaled = F.transform("features", lambda x: x.cast("double") * 10)
    return values(base(spark, sf).select("id", truncate_vector(scaled).alias("v")), "id", "v")


def q_unique_refill(spark, sf):
    """Three partitions from those of each row's five nearest rows; labels, folded to eight, are the partitions."""
    parts = base(spark, sf).withColumn("label", F.col("label") % 8)
    near = knn.knn_join(asked(spark, sf), base(spark, sf), 5)
    named = knn.lookup_labels(near, parts, "label").select(F.col("qid").alias("id"), "labels")
    return values(named.select("id", unique_refill(F.col("labels"), 3, 8).alias("v")), "id", "v", "part")


# Sources and sinks


def q_fvecs_scan(spark, sf):
    path = fresh_path(spark, "base") + ".fvecs"
    vecs.write_fvecs(base(spark, sf), path)
    return values(vecs.read_fvecs(spark, path), "id", "features")


def q_fvecs_id_range(spark, sf):
    """A range of ids, of which only the byte ranges are read."""
    path = fresh_path(spark, "base") + ".fvecs"
    vecs.write_fvecs(base(spark, sf), path)
    rows = vecs.read_fvecs(spark, path, splitBytes="8192")
    return values(rows.where("id >= 100 and id < 250 and id not in (120, 130)"), "id", "features")


def q_fvecs_scan_normalized(spark, sf):
    path = fresh_path(spark, "base") + ".fvecs"
    vecs.write_fvecs(base(spark, sf), path)
    return values(vecs.read_fvecs(spark, path, normalize=True), "id", "features")


def q_ivecs_scan(spark, sf):
    path = fresh_path(spark, "truth") + ".ivecs"
    vecs.write_ivecs(truth(spark, sf), path, order_by="qid")
    return values(vecs.read_ivecs(spark, path), "id", "neighbors", "neighbor")


def q_ivecs_scan_normalized(spark, sf):
    path = fresh_path(spark, "truth") + ".ivecs"
    vecs.write_ivecs(truth(spark, sf), path, order_by="qid")
    return values(vecs.read_ivecs(spark, path, normalize=True), "id", "neighbors")


def q_dataset_load(spark, sf):
    """Rows and values per table of a dataset stored as fvecs, ivecs."""
    folder = fresh_path(spark, "dataset")
    vecs.write_fvecs(base(spark, sf), f"{folder}/base.fvecs")
    vecs.write_fvecs(asked(spark, sf), f"{folder}/query.fvecs", order_by="qid")
    vecs.write_ivecs(truth(spark, sf), f"{folder}/truth.ivecs", order_by="qid")
    data = tables.read_dataset(
        spark, f"{folder}/base.fvecs", f"{folder}/query.fvecs", f"{folder}/truth.ivecs",
        learn=f"{folder}/base.fvecs",
    )
    out = None
    for name, table, column in (
        ("base", data.base, "features"), ("learn", data.learn, "features"),
        ("query", data.queries, "features"), ("truth", data.truth, "neighbors"),
    ):
        total = F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
        row = table.agg(
            F.lit(name).alias("name"), F.count("*").alias("rows"), F.round(F.sum(total), 4).alias("total")
        )
        out = row if out is None else out.unionByName(row)
    return out


def q_parquet_scan(spark, sf):
    folder = fresh_path(spark, "dataset")
    base(spark, sf).select("id", "features").write.parquet(f"{folder}/train")
    asked(spark, sf).write.parquet(f"{folder}/test")
    truth(spark, sf).write.parquet(f"{folder}/neighbors")
    data = tables.read_dataset(spark, f"{folder}/train", f"{folder}/test", f"{folder}/neighbors")
    first = values(data.truth, "qid", "neighbors", "neighbor")
    return first.join(data.queries, "qid").join(
        data.base.select(F.col("id").alias("neighbor"), F.col("features").alias("other")), "neighbor"
    ).select("qid", "neighbor", F.round(cosine_distance("features", "other"), 6).alias("distance"))


def q_with_row_id(spark, sf):
    rows = tables.with_row_id(spark.read.schema(SCHEMA).parquet(f"{sf}/embeddings.parquet"), "row_id")
    return rows.select("row_id", "vec_id", "label")


def q_zip_join(spark, sf):
    rows = spark.read.schema(SCHEMA).parquet(f"{sf}/embeddings.parquet")
    zipped = tables.zip_join(rows.select("vec_id"), rows.select("label"))
    return zipped.select("id", "vec_id", "label")


def q_load_assignment(spark, sf):
    path = fresh_path(spark, "cells") + ".csv"
    tables.save_assignment(base(spark, sf).withColumn("cell", F.col("label")), path)
    return tables.load_assignment(base(spark, sf), path).select("id", "cell")


def q_save_load_model(spark, sf):
    path = fresh_path(spark, "model")
    fine, coarse = fine_cells(spark, sf), coarse_cells(spark, sf)
    tables.save_model(path, cl.assign_cells(base(spark, sf), fine), fine, coarse)
    _, fine, coarse = tables.load_model(base(spark, sf), path)
    both = fine.withColumn("level", F.lit("fine")).unionByName(coarse.withColumn("level", F.lit("coarse")))
    rows = both.select("level", "cell", F.posexplode("centroid").alias("pos", "item"))
    return rows.select("level", "cell", "pos", F.round("item", 6).alias("value"))


def q_load_model_cells(spark, sf):
    """The cells of a saved clustering, attached to the rows by position."""
    path = fresh_path(spark, "model")
    fine = fine_cells(spark, sf)
    tables.save_model(path, cl.assign_cells(base(spark, sf), fine), fine, coarse_cells(spark, sf))
    return tables.load_model(base(spark, sf), path)[0].select("id", "cell")


# Sampling


def q_train_prefix(spark, sf):
    return sampling.train_prefix(base(spark, sf), 0.05).select("id")


def q_sample_per_cell(spark, sf):
    rows = base(spark, sf)
    return sampling.sample_per_cell(rows, 0.05, cell="label").select("id", "label")


def q_sample_bernoulli(spark, sf):
    return sampling.sample_bernoulli(base(spark, sf), 0.2).select("id", "label")


def q_stratum_fractions(spark, sf):
    return sampling.stratum_fractions(base(spark, sf), "label", 0.3)


def q_sample_by_stratum(spark, sf):
    """Every label with a fraction of its own."""
    fractions = sampling.stratum_fractions(base(spark, sf), "label", 0.1)
    fractions = fractions.withColumn("fraction", F.col("fraction") * F.col("label"))
    return sampling.sample_bernoulli(
        base(spark, sf), 0.0, stratum="label", fractions=fractions
    ).select("id", "label")


# Clustering and packing


def q_assign_cells(spark, sf):
    return cl.assign_cells(base(spark, sf), label_means(spark, sf)).select("id", "cell")


def q_cell_counts(spark, sf):
    return cl.cell_counts(assigned(spark, sf), FINE + 2)


def q_kmeans_lloyd(spark, sf):
    return values(fine_cells(spark, sf), "cell", "centroid")


def q_kmeans_ml(spark, sf):
    model = cl.fit_kmeans(base(spark, sf), FINE, seed=0)
    return cl.cell_counts(cl.attach_cells(base(spark, sf), model), FINE)


def _cost(rows, centroids):
    """Sum of the squared distances of rows from the centroid of their cell."""
    center = F.broadcast(centroids.withColumnRenamed("cell", "_cell"))
    gap = l2_distance("features", "centroid")
    return rows.join(center, F.col("cell") == F.col("_cell")).agg(F.sum(gap * gap)).first()[0]


def _fit_checked(rows, centroids, labelled, name):
    """What holds for any fit: rows of `labelled` off their nearest centroid, and whether means cost more.

    The means of the cells are the best centroids for them, so the cost of one more step is never above the fit's.
    """
    nearest = cl.assign_cells(rows.select("id", "features"), centroids, column="near").select("id", "near")
    off = labelled.join(nearest, "id").where("cell <> near").count()
    better = cl.kmeans_lloyd(rows, centroids, 1)
    return labelled.agg(
        F.lit(name).alias("level"), F.count("*").alias("rows"), F.lit(centroids.count()).alias("cells"),
        F.lit(off).cast("long").alias("off_nearest"),
        F.lit(_cost(labelled, better) <= _cost(labelled, centroids) * (1 + 1e-9)).alias("step_costs_no_more"),
    )


def q_kmeans_ml_checked(spark, sf):
    """The library fit on all rows, by the properties that any fit has."""
    rows = base(spark, sf)
    model = cl.fit_kmeans(rows, FINE, seed=0)
    return _fit_checked(rows, cl.centroid_table(spark, model.clusterCenters()), cl.attach_cells(rows, model), "fine")


def q_two_level_fit_checked(spark, sf):
    """Both levels fitted on the training prefix, and the cells of all rows under them."""
    rows = base(spark, sf)
    fine, coarse = cl.fit_two_levels(rows, 2, 10)
    return _fit_checked(rows, fine, cl.assign_cells(rows, fine), "fine").unionByName(
        _fit_checked(rows, coarse, cl.assign_cells(rows, coarse), "coarse"))


def q_two_level_cells(spark, sf):
    """The cell of every row under both sets of centroids."""
    rows = cl.assign_cells(base(spark, sf), fine_cells(spark, sf))
    return cl.assign_cells(rows, coarse_cells(spark, sf), column="coarse").select("id", "cell", "coarse")


def q_two_level_fit(spark, sf):
    """Library-fitted centroids of both levels, from the training prefix."""
    fine, coarse = cl.fit_two_levels(base(spark, sf), 2, 10)
    both = fine.withColumn("level", F.lit("fine")).unionByName(coarse.withColumn("level", F.lit("coarse")))
    return both.select("level", "cell", F.size("centroid").alias("dimensions"))


def q_centroid_rank(spark, sf):
    ranked = cl.rank_cells(coarse_cells(spark, sf), fine_cells(spark, sf))
    return ranked.select("coarse", "cell", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


def q_balance_cells(spark, sf):
    """Packings into two and into four bins, in one job."""
    fine = model_table(fine_cells(spark, sf))
    counts = model_table(cl.cell_counts(cl.assign_cells(base(spark, sf), fine), FINE))
    ranks, sizes = None, None
    for bins in (2, GROUPS):
        r = cl.rank_cells(coarse_cells(spark, sf, bins), fine).withColumn("bins", F.lit(bins))
        n = counts.withColumn("bins", F.lit(bins))
        ranks = r if ranks is None else ranks.unionByName(r)
        sizes = n if sizes is None else sizes.unionByName(n)
    return packing.balance_cells(ranks, sizes, config="bins")


def q_cell_to_part(spark, sf):
    return packing.cell_to_part(packed(spark, sf), FINE)


def q_remap_cells(spark, sf):
    return packing.remap_cells(assigned(spark, sf), cell_map(spark, sf)).select("id", "cell", "part")


def q_remap_cell_lists(spark, sf):
    """The partitions of the three cells nearest to each row."""
    fine = fine_cells(spark, sf)
    near = knn.knn_join(
        asked(spark, sf),
        fine.select(F.col("cell").alias("id"), F.col("centroid").alias("features")), 3, "l2",
    )
    lists = ev.neighbor_lists(near)
    mapped = packing.remap_cell_lists(lists, cell_map(spark, sf), "neighbors", "parts")
    return values(mapped, "qid", "parts", "part")


def q_part_sizes(spark, sf):
    rows = packing.remap_cells(assigned(spark, sf), cell_map(spark, sf))
    return packing.part_sizes(packing.repartition_by_part(rows), PARTS)


# Nearest-neighbour joins


def _exact(metric, **options):
    def query(spark, sf):
        return shown(knn.knn_join(asked(spark, sf), base(spark, sf), K, metric, **options))

    return query


def q_topk_per_query(spark, sf):
    """The ten best of each query's five best per label."""
    everywhere = F.array(*[F.lit(x) for x in range(FINE)])
    candidates = knn.knn_join(
        asked(spark, sf).withColumn("probes", everywhere), base(spark, sf), 5,
        probes="probes", part="label", per_part=True,
    )
    return shown(knn.topk_per_query(candidates.drop("rank", "part"), K))


def q_knn_pruned(spark, sf):
    return shown(knn.knn_join(probing(spark, sf), base(spark, sf), K, probes="probes", part="label"))


def q_knn_blocks(spark, sf):
    """The same join in the form for two large sides, cut into small blocks."""
    return shown(knn.knn_join(
        probing(spark, sf), base(spark, sf), K, "l2", probes="probes", part="label",
        strategy="blocks", limits=knn.Limits(base_block_rows=150, query_block_rows=250),
    ))


BLOCKS = knn.Limits(base_block_rows=150, query_block_rows=250, bound_rows=100, bound_share=4)
GROUPED = knn.Limits(broadcast_bytes=40_000, bound_rows=100, bound_share=4)
BOUNDED = knn.Limits(bound_rows=100, bound_share=4)


def q_knn_query_groups(spark, sf):
    """The join in two given labels, the queries sent to the base in groups."""
    return shown(knn.knn_join(
        probing(spark, sf), base(spark, sf), K, "l2", probes="probes", part="label",
        strategy="query_groups", limits=GROUPED,
    ))


def q_knn_cells_exact(spark, sf):
    """Exact search that leaves out cells by their radius."""
    fine = fine_cells(spark, sf)
    rows = cl.assign_cells(base(spark, sf), fine)
    return shown(knn_cells_exact(asked(spark, sf), rows, fine, K))


def q_knn_cells(spark, sf):
    fine = fine_cells(spark, sf)
    rows = cl.assign_cells(base(spark, sf), fine)
    return shown(plan.knn_cells(asked(spark, sf), rows, fine, K, n_cells=3))


def q_neighbor_ids(spark, sf):
    found = plan.exact_search(base(spark, sf), asked(spark, sf), CONFIG)
    return values(knn.neighbor_ids(knn.as_predictions(found)), "qid", "neighbors", "neighbor")


def q_knn_result(spark, sf):
    """Nested predictions, stored and read back in query order."""
    path = fresh_path(spark, "result")
    found = plan.exact_search(base(spark, sf), asked(spark, sf), CONFIG)
    tables.save_result(knn.as_predictions(found, asked(spark, sf)), path)
    nested = knn.ordered_result(spark.read.parquet(path))
    rows = nested.select("qid", F.posexplode("prediction").alias("pos", "hit"))
    return rows.select("qid", "pos", F.col("hit.neighbor"), F.round("hit.distance", 6).alias("distance"))


def q_lookup_labels(spark, sf):
    found = plan.exact_search(base(spark, sf), asked(spark, sf), CONFIG)
    return values(knn.lookup_labels(found, base(spark, sf), "label"), "qid", "labels", "label")


# Routing and whole searches


def _routed(order):
    def query(spark, sf):
        built = index(spark, sf)
        routed = routing.route_queries(
            asked(spark, sf), built.sample, PARTS, PROBES, NEIGHBORS, probe_order=order
        )
        return values(routed, "qid", "probes", "part")

    return query


def q_route_queries_tree(spark, sf):
    """Routing through a tree of centroids; with every branch in the beam and every cell looked at, as without it."""
    config = plan.replace(CONFIG, route_cells=FINE, route_beam=FINE)
    routed = plan.route(index(spark, sf), asked(spark, sf), config)
    return values(routed, "qid", "probes", "part")


def q_pruned_search(spark, sf):
    return shown(plan.pruned_search(
        base(spark, sf), asked(spark, sf), CONFIG, fine_cells(spark, sf), coarse_cells(spark, sf)
    ))


def q_pruned_search_by_id(spark, sf):
    config = plan.replace(CONFIG, probe_order="id")
    return shown(plan.pruned_search(
        base(spark, sf), asked(spark, sf), config, fine_cells(spark, sf), coarse_cells(spark, sf)
    ))


def q_pruned_search_1level(spark, sf):
    return shown(plan.pruned_search_1level(
        base(spark, sf), asked(spark, sf), CONFIG, coarse_cells(spark, sf)
    ))


def q_pruned_search_saved(spark, sf):
    path = fresh_path(spark, "model")
    plan.build_and_save(base(spark, sf), path, CONFIG, fine_cells(spark, sf), coarse_cells(spark, sf))
    return shown(plan.pruned_search_saved(base(spark, sf).drop("label"), asked(spark, sf), path, CONFIG))


def q_pruned_search_self_excluded(spark, sf):
    config = plan.replace(CONFIG, exclude_self=True)
    return shown(plan.pruned_search(
        base(spark, sf), asked(spark, sf), config, fine_cells(spark, sf), coarse_cells(spark, sf)
    ))


def q_search_reopened_index(spark, sf):
    """An index stored, opened again by its path, and searched."""
    path = fresh_path(spark, "index")
    built = plan.build_index(
        base(spark, sf), CONFIG, fine_cells(spark, sf), coarse_cells(spark, sf), path=f"{path}/base"
    )
    plan.save_index(built, path)
    return shown(plan.search(plan.load_index(spark, path), asked(spark, sf)))


def q_search_exact(spark, sf):
    """Exact search in an index, by the radii of its cells."""
    return shown(plan.search_exact(index(spark, sf), asked(spark, sf)))


def q_pruned_search_fitted(spark, sf):
    """Centroids fitted by the library on the training prefix."""
    config = plan.replace(CONFIG, cells_per_part=3)
    return shown(plan.pruned_search(base(spark, sf), asked(spark, sf), config))


def q_pruned_search_fitted_all(spark, sf):
    """Fitted centroids and every partition probed: whatever the fit, the result is the exact one."""
    config = plan.replace(CONFIG, cells_per_part=3, n_probes=PARTS)
    return shown(plan.pruned_search(base(spark, sf), asked(spark, sf), config))


# Evaluation


def q_recall_at_k(spark, sf):
    out = ev.recall_at_k(predicted(spark, sf), truth(spark, sf), K)
    return out.withColumn("recall", F.round("recall", 6))


def q_positional_match(spark, sf):
    out = ev.positional_match(predicted(spark, sf), truth(spark, sf), K)
    return out.withColumn("match_rate", F.round("match_rate", 6))


def q_recall_first_nn(spark, sf):
    """With the own row excluded from the search but not from the truth moved down by one."""
    own = knn.knn_join(asked(spark, sf), base(spark, sf), K, exclude_self=True)
    pruned = knn.knn_join(
        probing(spark, sf), base(spark, sf), K, probes="probes", part="label", exclude_self=True
    )
    out = ev.recall_first_nn(ev.neighbor_lists(pruned), ev.neighbor_lists(own), K)
    return out.withColumn("recall", F.round("recall", 6))


def q_partition_coverage(spark, sf):
    parts = base(spark, sf).select("id", F.col("label").alias("part"))
    out = ev.partition_coverage(truth(spark, sf), parts, FINE, K)
    return out.withColumn("share", F.round("share", 6))


def q_recall_sweep(spark, sf):
    out = plan.recall_sweep(
        index(spark, sf), asked(spark, sf), truth(spark, sf), list(SWEEP_K), list(SWEEP_PROBES)
    )
    return out.withColumn("recall", F.round("recall", 6))


def q_recall_sweep_by_id(spark, sf):
    """The sweep with the lowest partition numbers first."""
    built = index(spark, sf, plan.replace(CONFIG, probe_order="id"))
    out = plan.recall_sweep(built, asked(spark, sf), truth(spark, sf), list(SWEEP_K), list(SWEEP_PROBES))
    return out.withColumn("recall", F.round("recall", 6))


# Signals


def q_frame_spectrum(spark, sf):
    out = frame_spectrum(
        base(spark, sf), "features", n_fft=32, win_length=20, hop_length=8, frame=1
    )
    return values(out, "id", "spectrum", "magnitude").withColumnRenamed("pos", "bin")


QUERIES = {
    "dist_cosine": _distance(cosine_distance),
    "dist_l2": _distance(l2_distance),
    "dist_ip": _distance(ip_distance),
    "max_normalize": q_max_normalize,
    "truncate_vectors": q_truncate_vectors,
    "unique_refill": q_unique_refill,
    "fvecs_scan": q_fvecs_scan,
    "fvecs_id_range": q_fvecs_id_range,
    "fvecs_scan_normalized": q_fvecs_scan_normalized,
    "ivecs_scan": q_ivecs_scan,
    "ivecs_scan_normalized": q_ivecs_scan_normalized,
    "dataset_load": q_dataset_load,
    "parquet_scan": q_parquet_scan,
    "with_row_id": q_with_row_id,
    "zip_join": q_zip_join,
    "load_assignment": q_load_assignment,
    "save_load_model": q_save_load_model,
    "load_model_cells": q_load_model_cells,
    "train_prefix": q_train_prefix,
    "sample_per_cell": q_sample_per_cell,
    "sample_bernoulli": q_sample_bernoulli,
    "stratum_fractions": q_stratum_fractions,
    "sample_by_stratum": q_sample_by_stratum,
    "assign_cells": q_assign_cells,
    "cell_counts": q_cell_counts,
    "kmeans_lloyd": q_kmeans_lloyd,
    "kmeans_ml": q_kmeans_ml,
    "kmeans_ml_checked": q_kmeans_ml_checked,
    "two_level_fit_checked": q_two_level_fit_checked,
    "two_level_cells": q_two_level_cells,
    "two_level_fit": q_two_level_fit,
    "centroid_rank": q_centroid_rank,
    "balance_cells": q_balance_cells,
    "cell_to_part": q_cell_to_part,
    "remap_cells": q_remap_cells,
    "remap_cell_lists": q_remap_cell_lists,
    "part_sizes": q_part_sizes,
    "knn_exact": _exact("cosine"),
    "knn_exact_l2": _exact("l2"),
    "knn_exact_ip": _exact("ip"),
    "knn_self_excluded": _exact("cosine", exclude_self=True),
    "knn_exact_blocks": _exact("l2", strategy="blocks", limits=BLOCKS),
    "knn_exact_query_groups": _exact("l2", strategy="query_groups", limits=GROUPED),
    "knn_broadcast_queries": _exact("cosine", strategy="broadcast_queries", limits=BOUNDED),
    "topk_per_query": q_topk_per_query,
    "knn_pruned": q_knn_pruned,
    "knn_blocks": q_knn_blocks,
    "knn_query_groups": q_knn_query_groups,
    "knn_cells": q_knn_cells,
    "knn_cells_exact": q_knn_cells_exact,
    "neighbor_ids": q_neighbor_ids,
    "knn_result": q_knn_result,
    "lookup_labels": q_lookup_labels,
    "route_queries": _routed("id"),
    "route_queries_by_distance": _routed("distance"),
    "route_queries_tree": q_route_queries_tree,
    "pruned_search": q_pruned_search,
    "pruned_search_by_id": q_pruned_search_by_id,
    "pruned_search_1level": q_pruned_search_1level,
    "pruned_search_saved": q_pruned_search_saved,
    "pruned_search_self_excluded": q_pruned_search_self_excluded,
    "search_reopened_index": q_search_reopened_index,
    "search_exact": q_search_exact,
    "pruned_search_fitted": q_pruned_search_fitted,
    "pruned_search_fitted_all": q_pruned_search_fitted_all,
    "recall_at_k": q_recall_at_k,
    "positional_match": q_positional_match,
    "recall_first_nn": q_recall_first_nn,
    "partition_coverage": q_partition_coverage,
    "recall_sweep": q_recall_sweep,
    "recall_sweep_by_id": q_recall_sweep_by_id,
    "frame_spectrum": q_frame_spectrum,
}
