import numpy as np
import pytest
from conftest import as_lists, brute
from pyspark.sql import functions as F

from vecframe.operators import evaluate as ev
from vecframe.operators.knn import Limits
from vecframe.operators.routing import route_queries
from vecframe.plans import search as plan

CONFIG = plan.SearchConfig(k=10, n_parts=6, n_probes=2, cells_per_part=4, train_rate=0.3, sample_rate=0.1)


@pytest.fixture(scope="module")
def data(make, blobs):
    return make(blobs[0]).cache(), make(blobs[1], id_col="qid").cache()


@pytest.fixture(scope="module")
def index(data):
    return plan.build_index(data[0], CONFIG)


def test_index_is_balanced_and_whole(index, data):
    assert index.base.count() == data[0].count()
    cells = index.cell_map.collect()
    assert sorted(r.cell for r in cells) == list(range(24))
    sizes = {r.cell: r.n for r in index.counts.collect()}
    sample = index.sample.groupBy("cell").count().collect()
    assert {r.cell: r["count"] for r in sample} == {c: round(n * 0.1) for c, n in sizes.items() if round(n * 0.1)}


@pytest.mark.parametrize("order", ["id", "distance"])
@pytest.mark.parametrize("strategy", ["auto", "blocks"])
def test_search_is_exact_within_its_partitions(index, data, blobs, order, strategy):
    config = plan.replace(
        CONFIG, probe_order=order, strategy=strategy, limits=Limits(base_block_rows=100, query_block_rows=20)
    )
    probes = {r.qid: r.probes for r in plan.route(index, data[1], config).collect()}
    assert all(len(p) == 2 == len(set(p)) for p in probes.values())
    part = {r.id: r.part for r in index.base.collect()}
    got = as_lists(plan.search(index, data[1], config))
    assert got == brute(blobs[1], blobs[0], 10, allowed=lambda i, j: part[j] in probes[i])


def test_recall_rises_with_probes(index, data):
    truth = ev.neighbor_lists(plan.exact_search(*data, CONFIG))
    rows = plan.recall_sweep(index, data[1], truth, [1, 10], [1, 2, 3, 6]).collect()
    recall = {(r.k, r.probes): r.recall for r in rows}
    for k in (1, 10):
        assert recall[k, 1] <= recall[k, 2] <= recall[k, 3] <= recall[k, 6] == 1.0
    assert recall[10, 1] > 0.5
    assert {r.probes: r.candidates for r in rows}[6] == data[0].count() * data[1].count()
    single = ev.recall_at_k(ev.neighbor_lists(plan.search(index, data[1])), truth, 10).first().recall
    assert single == pytest.approx(recall[10, 2])


@pytest.mark.parametrize("order", ["id", "distance"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_every_search_follows_from_the_lists(make, blobs, order, exclude_self):
    """Each setting of a sweep is the search with that setting, in both probe orders."""
    base = make(blobs[0][:400])
    queries = make(blobs[0][:40], id_col="qid")
    built = plan.build_index(base, plan.replace(CONFIG, probe_order=order, exclude_self=exclude_self, sample_rate=0.3))
    truth = ev.neighbor_lists(plan.exact_search(base, queries, plan.replace(CONFIG, exclude_self=exclude_self)))
    swept = {(r.k, r.probes): r.recall for r in plan.recall_sweep(built, queries, truth, [3, 10], [2, 3, 6]).collect()}
    for k, n in swept:
        alone = plan.search(built, queries, plan.replace(built.config, k=k, n_probes=n))
        assert swept[k, n] == pytest.approx(ev.recall_at_k(ev.neighbor_lists(alone), truth, k).first().recall)
    lists, _ = plan.sweep_lists(built, queries, 10, 6, 2)
    free, _ = plan.sweep_lists(built, queries, 10, 6, 1)
    assert lists.count() <= free.count() < 40 * 6 * 10


def test_one_level(data):
    found = plan.pruned_search_1level(*data, plan.replace(CONFIG, n_probes=6))
    exact = plan.exact_search(*data, CONFIG)
    assert as_lists(found) == as_lists(exact)


def test_saved_models(data, tmp_path):
    plan.build_many(data[0], str(tmp_path), [2, 3], plan.replace(CONFIG, cells_per_part=3))
    for n in (2, 3):
        config = plan.replace(CONFIG, n_parts=n, n_probes=n)
        found = plan.pruned_search_saved(*data, f"{tmp_path}/{n}", config)
        assert as_lists(found) == as_lists(plan.exact_search(*data, CONFIG))


def test_self_exclusion(make, blobs):
    base = make(blobs[0][:300])
    config = plan.replace(CONFIG, n_probes=6, exclude_self=True, cells_per_part=2)
    found = plan.pruned_search(base, base.withColumnRenamed("id", "qid"), config)
    assert as_lists(found) == brute(blobs[0][:300], blobs[0][:300], 10, exclude_self=True)


def test_routing_through_cells(index, data):
    wide = plan.replace(CONFIG, route_cells=24)
    a = {r.qid: r.probes for r in plan.route(index, data[1]).collect()}
    assert a == {r.qid: r.probes for r in plan.route(index, data[1], wide).collect()}
    narrow = plan.route(index, data[1], plan.replace(CONFIG, route_cells=3)).collect()
    assert all(len(r.probes) == 2 for r in narrow)


def test_routing_through_a_tree(spark, index, data, blobs):
    branches, cells = plan.cell_tree(index.centroids)
    assert branches.count() == 5 and cells.count() == 24  # the root of 24, rounded up
    hung = {r.cell: r.branch for r in cells.collect()}
    centers = {r.cell: np.array(r.centroid) for r in index.centroids.collect()}
    tops = {r.cell: np.array(r.centroid) for r in branches.collect()}
    for c, b in hung.items():
        assert b == min(tops, key=lambda t: (round(np.linalg.norm(tops[t] - centers[c]), 9), t))
    flat = {r.qid: r.cells for r in plan.nearest_cells(data[1], index.centroids, 4).collect()}
    whole = plan.nearest_cells(data[1], index.centroids, 4, tree=(branches, cells), beam=5)
    assert {r.qid: r.cells for r in whole.collect()} == flat
    narrow = {r.qid: r.cells for r in plan.nearest_cells(data[1], index.centroids, 4, tree=(branches, cells), beam=2).collect()}
    found = np.mean([len(set(narrow[q]) & set(flat[q])) / 4 for q in flat])
    assert found > 0.6 and all(len({hung[c] for c in cs}) <= 2 for cs in narrow.values())
    # Recall of the whole search: through two of five branches against the flat routing.
    truth = ev.neighbor_lists(plan.exact_search(*data, CONFIG))

    def recall(**options):
        got = plan.search(index, data[1], plan.replace(CONFIG, **options))
        return ev.recall_at_k(ev.neighbor_lists(got), truth, 10).first().recall

    assert recall(route_cells=4, route_beam=2) > recall() - 0.1
    for n in (1, 2):
        tops, hung = plan.cell_tree(index.centroids.where(f"cell < {n}"))
        assert tops.count() == n and hung.count() == n


def test_knn_cells(index, data, blobs):
    got = as_lists(plan.knn_cells(data[1], index.base, index.centroids, 10, n_cells=3))
    centers = np.array([r.centroid for r in sorted(index.centroids.collect())])
    near = brute(blobs[1], centers, 3)
    cell = {r.id: r.cell for r in index.base.collect()}
    assert got == brute(blobs[1], blobs[0], 10, allowed=lambda i, j: cell[j] in near[i])


def test_routing_details(make):
    sample = make({5: [1, 0], 6: [0.9, 0.1], 7: [0, 1]}, part=[3, 1, 2])
    queries = make({0: [1, 0], 1: [0, 0]}, id_col="qid")

    def probes(**options):
        return {r.qid: r.probes for r in route_queries(queries, sample, 4, 2, **options).collect()}

    assert probes(neighbors=2) == {0: [1, 3], 1: [0, 1]}
    assert probes(neighbors=2, probe_order="distance") == {0: [3, 1], 1: [0, 1]}
    assert probes(neighbors=1) == {0: [3, 0], 1: [0, 1]}
    assert probes(neighbors=1, truncate=True) == {0: [3, 0], 1: [0, 1]}
    bounded = route_queries(queries, sample, 4, 2, 2, probe_order="distance", bound_k=2)
    bound = {r.qid: r.bound for r in bounded.collect()}
    assert bound[0] > 0 and bound[1] is None


def test_zero_query_gets_an_empty_result(index, make):
    queries = make({0: [0] * 16, 1: [1] * 16}, id_col="qid")
    assert set(as_lists(plan.search(index, queries))) == {1}
    assert plan.route(index, queries).where(F.size("probes") == 2).count() == 2


@pytest.mark.parametrize("strategy", ["broadcast_queries", "blocks"])
def test_search_reads_only_probed_folders(index, data, strategy):
    """The probed partitions must reach the scan of the table stored by cell."""
    found = plan.search(index, data[1].where("qid = 3"), plan.replace(CONFIG, n_probes=1, strategy=strategy))
    text = found._jdf.queryExecution().executedPlan().toString()
    scans = [s.split("]", 1)[0] for s in text.split("PartitionFilters: [isnotnull(cell")[1:]]
    assert any("isnotnull([" in s for s in scans), text
    assert "Nested" not in text and "Cartesian" not in text


def test_partitions_follow_the_centroids(spark, data):
    from vecframe.operators.clustering import centroid_table

    base, queries = data
    vectors = np.array([r.features for r in base.orderBy("id").limit(12).collect()])
    twelve = centroid_table(spark, vectors)
    built = plan.build_index_1level(base, plan.SearchConfig(k=5, n_parts=8, n_probes=8), twelve)
    assert built.config.n_parts == 12
    assert built.base.where("part is null").count() == 0 and built.base.count() == base.count()
    four = centroid_table(spark, vectors[:4])
    built = plan.build_index(base, plan.SearchConfig(k=1, n_parts=2, n_probes=4), twelve, four)
    mine = base.where("id < 30").select(F.col("id").alias("qid"), "features")
    assert as_lists(plan.search(built, mine)) == {i: [i] for i in range(30)}


def test_cells_without_centroid_are_refused(spark, data):
    from vecframe.operators.clustering import centroid_table

    base, _ = data
    vectors = np.array([r.features for r in base.orderBy("id").limit(12).collect()])
    own = base.withColumn("cell", (F.col("id") % 20).cast("int"))
    with pytest.raises(ValueError, match="cells outside"):
        plan.build_index(own, CONFIG, centroid_table(spark, vectors), centroid_table(spark, vectors[:6]))
    with pytest.raises(ValueError, match="must run from 0"):
        plan.build_index_1level(base, CONFIG, centroid_table(spark, vectors[:2], [0, 5]))
