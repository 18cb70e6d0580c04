"""Whole searches: build an index over base vectors once, then answer query tables with it."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecframe.operators.clustering import (
    assign_cells,
    cell_counts,
    fit_levels,
    fit_two_levels,
    kmeans_lloyd,
)
from vecframe.operators.exact_cells import cell_radii, knn_cells_exact
from vecframe.operators.evaluate import neighbor_lists, sweep_recall
from vecframe.operators.knn import Limits, knn_join
from vecframe.operators.packing import (
    balance_near,
    cell_to_part,
    part_sizes,
    remap_cells,
    write_by_cell,
)
from vecframe.operators.routing import route_queries
from vecframe.operators.sampling import sample_per_cell
from vecframe.session import fresh_path, model_table, write_and_read
from vecframe.sources.tables import check_dense, load_model, save_model


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of an index and of the searches on it. The numbers are fixed defaults."""

    k: int = 10
    n_parts: int = 8
    n_probes: int = 3
    cells_per_part: int = 5
    train_rate: float = 0.05
    sample_rate: float = 0.05
    sample_seed: int = 42
    route_neighbors: int = 30
    route_cells: int | None = None  # search the sample only in this many nearest fine cells
    route_beam: int | None = None  # find those cells among the children of this many branches of a tree of centroids
    metric: str = "cosine"
    probe_order: str = "distance"  # "id" keeps the lowest partition ids instead
    truncate_sample: bool = False
    exclude_self: bool = False
    seed: int = 0
    max_iter: int = 20
    strategy: str = "auto"
    limits: Limits = Limits()


# Fixed values of the one-level search: fewer routing neighbours, one more partition.
ONE_LEVEL = SearchConfig(n_probes=4, route_neighbors=10)


@dataclass(frozen=True)
class SearchIndex:
    """Base rows stored by cell, the partition of each cell, and the routing sample."""

    config: SearchConfig
    centroids: DataFrame  # cell, centroid of the cells
    base: DataFrame  # id, features, cell, part
    cell_map: DataFrame  # cell, part
    counts: DataFrame  # cell, n
    sample: DataFrame  # id, features, cell, part
    folder: str  # where the base rows are stored
    radii: DataFrame | None = None  # cell, radius, n; for exact search under l2 and cosine


def build_index(
    base: DataFrame,
    config: SearchConfig = SearchConfig(),
    fine: DataFrame | None = None,
    coarse: DataFrame | None = None,
    path: str | None = None,
) -> SearchIndex:
    """Two-level index: fine cells, packed into partitions of even size around coarse centroids.

    Centroids are fitted on the training prefix unless given. A base that already carries a
    `cell` column keeps it; a cell that has no centroid is an error. There are as many partitions as
    coarse centroids. The rows are stored under `path`, by default in the shared folder.
    """
    if fine is None or coarse is None:
        fine, coarse = _fit(base, config)
    fine, coarse = model_table(fine), model_table(coarse)
    n_cells = check_dense(fine, "cell")
    config = replace(config, n_parts=check_dense(coarse, "cell"))
    path = path or fresh_path(base.sparkSession, "cells")
    stored = _store(base, fine, path, n_cells)
    counts = model_table(cell_counts(stored, n_cells))
    packed = balance_near(coarse, fine, counts)
    return _finish(config, fine, stored, model_table(cell_to_part(packed, n_cells)), counts, path)


def build_index_1level(
    base: DataFrame,
    config: SearchConfig = ONE_LEVEL,
    centroids: DataFrame | None = None,
    path: str | None = None,
) -> SearchIndex:
    """One-level index: the k-means cells are the partitions, as many as there are centroids."""
    if centroids is None:
        (centroids,) = fit_levels(
            base, [config.n_parts], config.train_rate, config.seed, config.max_iter
        )
    centroids = model_table(centroids)
    config = replace(config, n_parts=check_dense(centroids, "cell"))
    path = path or fresh_path(base.sparkSession, "cells")
    stored = _store(base, centroids, path, config.n_parts)
    counts = model_table(cell_counts(stored, config.n_parts))
    cell_map = model_table(counts.select("cell", F.col("cell").alias("part")))
    return _finish(config, centroids, stored, cell_map, counts, path)


def _fit(base, config):
    return fit_two_levels(
        base, config.n_parts, config.n_parts * config.cells_per_part,
        config.train_rate, config.seed, config.max_iter,
    )


def _store(base, centroids, path, n_cells):
    if "cell" not in base.columns:
        base = assign_cells(base, centroids)
    rows = base.select(F.col("id").cast("long"), "features", F.coalesce("cell", F.lit(0)).alias("cell"))
    stored = write_by_cell(rows, path)
    # Cells are folders of the stored table, so this looks at those out of range only.
    if not stored.where((F.col("cell") < 0) | (F.col("cell") >= n_cells)).isEmpty():
        raise ValueError(f"the base has cells outside 0 to {n_cells - 1}, the cells of the centroids")
    return stored


def _finish(config, centroids, stored, cell_map, counts, path):
    sample = sample_per_cell(stored, config.sample_rate, seed=config.sample_seed)
    return SearchIndex(
        config,
        centroids,
        remap_cells(stored, cell_map),
        cell_map,
        counts,
        write_and_read(remap_cells(sample, cell_map), "sample"),
        path,
    )


# ---- stored indexes


_TABLES = ("centroids", "cell_map", "counts", "sample", "radii")
_FORMAT = 1


def with_radii(index: SearchIndex) -> SearchIndex:
    """The index with the radius of every cell, found in one pass over the base; unchanged under inner products."""
    if index.radii is not None or index.config.metric == "ip":
        return index
    radii = write_and_read(cell_radii(index.base, index.centroids, index.config.metric), "radii")
    return replace(index, radii=radii)


def save_index(index: SearchIndex, path: str) -> SearchIndex:
    """Store an index under `path`, to be opened by `load_index`; the stored index is returned.

    Base rows that `build_index` has put under `path`/base already stay where they are; others are copied. The
    manifest is written last, so a folder without one is not an index. A path that holds an index is refused.
    """
    index = with_radii(index)
    spark = index.base.sparkSession
    tables = {name: getattr(index, name) for name in _TABLES if getattr(index, name) is not None}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    rows = index.base.drop("part")
    if index.folder.rstrip("/") != f"{path.rstrip('/')}/base":
        write_by_cell(rows, f"{path}/base")
    manifest = {
        "format": _FORMAT,
        "config": asdict(index.config),
        "schemas": {name: table.schema.jsonValue() for name, table in (tables | {"base": rows}).items()},
    }
    spark.range(1).coalesce(1).select(F.lit(json.dumps(manifest))).write.text(f"{path}/manifest")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    """Open an index that `save_index` has stored. Only its manifest and cell map are read; no base row is.

    Schemas come from the manifest, and the rows are found by their folders, so nothing is fitted, assigned,
    joined or rewritten.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["format"] != _FORMAT:
        raise ValueError(f"{path} has format {manifest['format']}, not {_FORMAT}")
    config = dict(manifest["config"])
    config["limits"] = Limits(**config["limits"])

    def table(name):
        if name not in manifest["schemas"]:
            return None
        return spark.read.schema(StructType.fromJson(manifest["schemas"][name])).parquet(f"{path}/{name}")

    cell_map = model_table(table("cell_map"))
    return SearchIndex(
        SearchConfig(**config), table("centroids"), remap_cells(table("base"), cell_map), cell_map,
        table("counts"), table("sample"), f"{path}/base", table("radii"),
    )


# ---- searches


def route(
    index: SearchIndex, queries: DataFrame, config: SearchConfig | None = None, bound_probes: int | None = None
) -> DataFrame:
    """`queries` (`qid, features`) with the partitions each is searched in, stored once.

    The bound on the k-th distance holds for a search of the first `bound_probes` partitions, by default of all.
    """
    c = config or index.config
    near = None
    if c.route_cells is not None:
        tree = None if c.route_beam is None else cell_tree(index.centroids)
        queries = _near(queries, index.centroids, c.route_cells, c.metric, tree=tree, beam=c.route_beam)
        near = "cells"
    routed = route_queries(
        queries, index.sample, index.config.n_parts, c.n_probes, c.route_neighbors, c.metric,
        c.probe_order, c.truncate_sample,
        # Without the query's own row, the k-th of the others is the (k + 1)-th of all at most.
        bound_k=c.k + int(c.exclude_self), bound_probes=bound_probes, cells=near,
        strategy=c.strategy, limits=c.limits,
    )
    return write_and_read(routed, "routed")


def search(
    index: SearchIndex, queries: DataFrame, config: SearchConfig | None = None, per_part: bool = False
) -> DataFrame:
    """`qid, neighbor, distance, rank`: the k nearest rows within each query's partitions.

    The k-th distance already seen in the routing sample bounds the search, so tasks emit only
    rows that can still make a list, however many tasks the base is read in.
    """
    c = config or index.config
    routed = route(index, queries, c)
    return knn_join(
        routed, index.base, c.k, c.metric, probes="probes",
        bound=None if per_part or "bound" not in routed.columns else "bound",
        exclude_self=c.exclude_self, per_part=per_part, clustered=True,
        strategy=c.strategy, limits=c.limits,
    )


def pruned_search(
    base: DataFrame,
    queries: DataFrame,
    config: SearchConfig = SearchConfig(),
    fine: DataFrame | None = None,
    coarse: DataFrame | None = None,
) -> DataFrame:
    """Build a two-level index and search it."""
    return search(build_index(base, config, fine, coarse), queries)


def pruned_search_1level(
    base: DataFrame,
    queries: DataFrame,
    config: SearchConfig = ONE_LEVEL,
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Build a one-level index and search it."""
    return search(build_index_1level(base, config, centroids), queries)


def build_and_save(
    base: DataFrame, path: str, config: SearchConfig = SearchConfig(),
    fine: DataFrame | None = None, coarse: DataFrame | None = None,
) -> None:
    """Fit the two-level clustering and save cells and both sets of centroids under `path`."""
    if fine is None or coarse is None:
        fine, coarse = _fit(base, config)
    save_model(path, assign_cells(base, fine), fine, coarse)


def build_many(base: DataFrame, path: str, part_counts: list[int], config: SearchConfig = SearchConfig()) -> None:
    """Save one clustering per number of partitions, under `path/<n>`; all are fitted on one training prefix."""
    sizes = [size for n in part_counts for size in (n * config.cells_per_part, n)]
    models = fit_levels(base, sizes, config.train_rate, config.seed, config.max_iter)
    for i, n in enumerate(part_counts):
        build_and_save(base, f"{path}/{n}", replace(config, n_parts=n), models[2 * i], models[2 * i + 1])


def pruned_search_saved(
    base: DataFrame, queries: DataFrame, path: str, config: SearchConfig = SearchConfig()
) -> DataFrame:
    """Search with a clustering saved by `build_and_save`."""
    assigned, fine, coarse = load_model(base, path)
    return search(build_index(assigned, config, fine, coarse), queries)


def exact_search(
    base: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()
) -> DataFrame:
    """Every query against every base row."""
    return knn_join(
        queries, base, config.k, config.metric, exclude_self=config.exclude_self,
        strategy=config.strategy, limits=config.limits,
    )


def search_exact(index: SearchIndex, queries: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """The k nearest rows of the whole base, reading only cells that can hold one.

    Inner products have no triangle inequality, so under them every row is compared.
    """
    c = config or index.config
    if c.metric == "ip":
        return exact_search(index.base, queries, c)
    radii = index.radii if c.metric == index.config.metric else None
    return knn_cells_exact(
        queries, index.base, index.centroids, c.k, c.metric, radii, strategy=c.strategy, limits=c.limits,
        exclude_self=c.exclude_self,
    )


def cell_tree(centroids: DataFrame, branches: int | None = None, steps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(branches: `cell, centroid`; cells with their branch: `cell, centroid, branch`) of a tree over the cells.

    The branches, by default the square root of the number of cells, start from cells at even steps and move to the
    means of the cells nearest to them a few times. Every cell hangs from the branch nearest to it.
    """
    cells = centroids.select("cell", F.col("centroid").alias("features"))
    numbered = cells.withColumn("place", F.row_number().over(Window.orderBy("cell")) - 1)  # one row per cell
    n = cells.count()
    branches = min(n, branches or math.isqrt(n - 1) + 1)
    step = F.lit(n / branches)
    chosen = F.floor(F.ceil(F.col("place") / step) * step) == F.col("place")
    start = numbered.where(chosen).select(
        (F.row_number().over(Window.orderBy("cell")) - 1).alias("cell"), F.col("features").alias("centroid")
    )
    moved = write_and_read(kmeans_lloyd(cells, write_and_read(start, "branches"), steps), "branches")
    hung = assign_cells(cells, moved, column="branch").withColumnRenamed("features", "centroid")
    return moved, write_and_read(hung, "cell-tree")


def nearest_cells(
    queries: DataFrame, centroids: DataFrame, n_cells: int, metric: str = "cosine",
    tree: tuple[DataFrame, DataFrame] | None = None, beam: int | None = None, **options,
) -> DataFrame:
    """`qid, cells`: the `n_cells` cells whose centroids are nearest each query, nearest first.

    With a `tree` (of `cell_tree`) a query meets the branches and the cells of its `beam` nearest branches only, and
    may miss cells of others; with all branches in the beam it misses none.
    """
    if tree is None:
        centers = centroids.select(F.col("cell").alias("id"), F.col("centroid").alias("features"))
        found = knn_join(queries, centers, n_cells, metric, **options)
    else:
        branches, cells = tree
        ahead = nearest_cells(queries, branches, beam or 1, metric, **options).withColumnRenamed("cells", "branches")
        asked = write_and_read(queries.select("qid", "features").join(ahead, "qid"), "branches-to-search")
        centers = cells.select(F.col("cell").alias("id"), F.col("centroid").alias("features"), "branch")
        found = knn_join(asked, centers, n_cells, metric, probes="branches", part="branch", **options)
    return neighbor_lists(found).withColumnRenamed("neighbors", "cells")


def _near(queries, centroids, n_cells, metric, **options):
    """`queries` with their nearest cells, stored because a join reads its query side repeatedly."""
    cells = nearest_cells(queries, centroids, n_cells, metric, **options)
    return write_and_read(queries.join(cells, "qid", "left"), "near")


def knn_cells(
    queries: DataFrame,
    base: DataFrame,
    centroids: DataFrame,
    k: int,
    n_cells: int,
    metric: str = "cosine",
    **options,
) -> DataFrame:
    """The k nearest rows within the `n_cells` fine cells whose centroids are nearest the query."""
    probing = _near(queries, centroids, n_cells, metric, **options)
    return knn_join(probing, base, k, metric, probes="cells", part="cell", **options)


def sweep_lists(
    index: SearchIndex, queries: DataFrame, k: int, most_probes: int, least_probes: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(`qid, part, neighbor, distance, rank`: the k nearest rows per query and partition; the routed queries), stored.

    From these lists follows every search with `least_probes` to `most_probes` partitions and up to k neighbours: in
    either probe order fewer partitions are the first of more. Rows farther than a query's k-th sample row within its
    first `least_probes` partitions are in no such result and left out, so lists do not grow with the tasks.
    """
    widest = replace(index.config, k=k, n_probes=most_probes)
    routed = route(index, queries, widest, bound_probes=least_probes)
    found = knn_join(
        routed, index.base, k, widest.metric, probes="probes", per_part=True,
        bound="bound" if "bound" in routed.columns else None, exclude_self=widest.exclude_self, clustered=True,
        strategy=widest.strategy, limits=widest.limits,
    )
    return write_and_read(found, "sweep-lists"), routed


def recall_sweep(
    index: SearchIndex, queries: DataFrame, truth: DataFrame, ks: list[int], probe_counts: list[int]
) -> DataFrame:
    """Recall and compared rows for every (k, number of probes), from a single search."""
    found, routed = sweep_lists(index, queries, max(ks), max(probe_counts), min(probe_counts))
    sizes = part_sizes(remap_cells(index.counts, index.cell_map).select(
        "part", F.col("n")
    ), index.config.n_parts, weight="n")
    return sweep_recall(found, routed, sizes, truth, ks, probe_counts)
