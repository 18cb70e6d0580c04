"""What keeps joins and indexes cheap on large tables: bounds, groups of queries, stored indexes, cell radii."""

import numpy as np
import pytest
from conftest import as_lists, brute
from pyspark.sql import functions as F

from vecframe.operators import knn
from vecframe.operators.exact_cells import cell_radii, knn_cells_exact
from vecframe.operators.knn import Limits, knn_join
from vecframe.plans import search as plan

CONFIG = plan.SearchConfig(k=10, n_parts=6, n_probes=2, cells_per_part=4, train_rate=0.3, sample_rate=0.1)
LARGE_FORMS = ("broadcast_queries", "query_groups", "blocks")


@pytest.fixture(scope="module")
def data(make, blobs):
    return make(blobs[0]).repartition(12).cache(), make(blobs[1], id_col="qid").cache()


def bounded(strategy, rows=0, share=8):
    size = 1500 if strategy == "query_groups" else 32 << 20
    return Limits(size, base_block_rows=200, query_block_rows=25, bound_rows=rows, bound_share=share)


@pytest.fixture
def partial_rows(monkeypatch):
    """Counts the rows of per-task lists that reach a merge."""
    seen, merge = [], knn._Job.merge

    def counting(self, partial, bounded):
        seen.append((bounded, partial.count()))
        return merge(self, partial, bounded)

    monkeypatch.setattr(knn._Job, "merge", counting)
    return seen


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("strategy", LARGE_FORMS)
def test_sampled_bounds_lose_nothing(make, blobs, data, strategy, metric, exclude_self):
    base, queries = data
    if exclude_self:
        queries = make(blobs[0][:60], id_col="qid")
    asked = blobs[0][:60] if exclude_self else blobs[1]
    got = knn_join(queries, base, 10, metric, strategy=strategy, limits=bounded(strategy), exclude_self=exclude_self)
    assert as_lists(got) == brute(asked, blobs[0], 10, metric, exclude_self=exclude_self)


def test_bounds_come_from_samples_of_samples(make, blobs, monkeypatch):
    base, queries = make(blobs[0]).repartition(12), make(np.repeat(blobs[1], 3, axis=0), id_col="qid")
    levels, inner = [], knn._with_bound

    def watched(job, q, b, limits, level, table=None):
        levels.append(level)
        return inner(job, q, b, limits, level, table)

    monkeypatch.setattr(knn, "_with_bound", watched)
    # The first sample is too large to be broadcast, so its search is bounded by a sample of it.
    limits = Limits(16_000, bound_rows=0, bound_share=4, query_groups=100)
    got = knn_join(queries, base, 5, limits=limits)
    assert max(levels) >= 1
    assert as_lists(got) == brute(np.repeat(blobs[1], 3, axis=0), blobs[0], 5)


def test_lists_do_not_grow_with_tasks(make, blobs, partial_rows):
    queries = make(blobs[1], id_col="qid").cache()
    for tasks in (30, 90):
        base = make(blobs[0]).repartition(tasks)
        as_lists(knn_join(queries, base, 10, strategy="broadcast_queries", limits=bounded("broadcast_queries")))
        as_lists(knn_join(queries, base, 10, strategy="broadcast_queries"))
    (known, few), (not_known, free), (_, many), (_, more) = partial_rows
    assert known and not not_known
    # About k rows for each of the eight base rows that a sample row stands for.
    assert few <= many < 1.1 * few and many < 1.3 * 10 * 8 * len(blobs[1])
    assert more == 3 * free > 5 * many


def test_groups_read_the_base_in_place(data):
    """No exchange of base rows: vectors are gone before the first one."""
    base, queries = data
    got = knn_join(queries, base, 3, strategy="query_groups", limits=bounded("query_groups", rows=10**9))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") > 1
    for exchange in text.split("Exchange hashpartitioning")[1:]:
        assert "vec" not in exchange.split("\n")[0]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_tasks_hold_and_hand_on_lists_in_portions(make, blobs, monkeypatch):
    """Lists of many partitions weigh more than their queries: what a task holds is bounded with them."""
    held, merged = [], knn._in_place
    monkeypatch.setattr(knn, "_HELD_BYTES", 20_000)
    monkeypatch.setattr(knn, "_in_place", lambda job, q, b: held.append(job.held_bytes(q)) or merged(job, q, b))
    part = [i % 7 for i in range(len(blobs[0]))]
    base = make(blobs[0], part=part)
    queries = make(blobs[1], id_col="qid", probes=[list(range(7))] * len(blobs[1]))
    limits = Limits(8_000, bound_rows=10**9)  # the queries fit, the base does not
    for strategy in ("broadcast_queries", "auto", "query_groups"):
        got = knn_join(queries, base, 4, probes="probes", part="part", per_part=True, strategy=strategy, limits=limits)
        rows = {}
        for r in sorted(got.collect(), key=lambda r: (r.qid, r.part, r.rank)):
            rows.setdefault((r.qid, r.part), []).append(r.neighbor)
        want = {p: brute(blobs[1], blobs[0], 4, allowed=lambda i, j, p=p: part[j] == p) for p in range(7)}
        assert rows == {(i, p): want[p][i] for p in range(7) for i in range(len(blobs[1]))}
    assert len(held) > 6 and max(held) <= 2 * 20_000
    lists = knn.TopK(np.arange(60), blobs[1], 4)
    lists.update(None, np.arange(len(blobs[0])), blobs[0])
    monkeypatch.setattr(knn, "_EMIT_ROWS", 40)
    batches = list(knn._Job(4, "cosine", False, False, False, False, False).emit(lists))
    assert [b.num_rows for b in batches] == [40] * 6
    assert [x for b in batches for x in b["qid"].to_pylist()] == np.repeat(np.arange(60), 4).tolist()


@pytest.mark.parametrize("rows", [0, 10**9])
def test_many_queries_are_broadcast_in_turns(data, blobs, rows):
    base, queries = data
    got = knn_join(queries, base, 5, strategy="broadcast_queries", limits=Limits(2000, bound_rows=rows, bound_share=8))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") > 1
    assert as_lists(got) == brute(blobs[1], blobs[0], 5)


@pytest.mark.parametrize("probes", [None, "probes"])
def test_groups_grow_rather_than_multiply(make, blobs, monkeypatch, probes):
    """Twice the queries do not make twice the passes, and no stage holds more than some passes."""
    portions, together, run, merge = [], [], knn._portions, knn._Job._top
    monkeypatch.setattr(knn, "_PASSES", 4)
    monkeypatch.setattr(knn, "_portions", lambda job, table, most: portions.append(table.num_rows) or run(job, table, most))

    def watched(self, lists, keys):
        together.append(lists._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return merge(self, lists, keys)

    monkeypatch.setattr(knn._Job, "_top", watched)
    limits = Limits(100, bound_rows=10**9, query_groups=6)
    part = [i % 7 for i in range(len(blobs[0]))]
    base = make(blobs[0], part=part)
    for times in (1, 3):
        asked = np.repeat(blobs[1], times, axis=0)
        lists = [[i % 7, (i + 3) % 7] for i in range(len(asked))]
        queries = make(asked, id_col="qid", probes=lists)
        portions.clear()
        got = knn_join(queries, base, 5, probes=probes, strategy="query_groups", limits=limits)
        assert as_lists(got) == brute(asked, blobs[0], 5, allowed=lambda i, j: probes is None or part[j] in lists[i])
        assert 2 <= len(portions) <= 6 and sum(portions) == len(asked)
    assert 1 < max(together) <= 4


def test_groups_by_partition_read_few_partitions(spark, make, blobs, tmp_path):
    part = [i % 8 for i in range(len(blobs[0]))]
    make(blobs[0], part=part).write.partitionBy("part").parquet(str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    probes = [[i % 8] for i in range(len(blobs[1]))]
    queries = make(blobs[1], id_col="qid", probes=probes)
    got = knn_join(queries, stored, 5, probes="probes", strategy="query_groups", limits=bounded("query_groups"))
    assert as_lists(got) == brute(blobs[1], blobs[0], 5, allowed=lambda i, j: part[j] in probes[i])
    text = got._jdf.queryExecution().executedPlan().toString()
    filters = [t.split("]")[0] for t in text.split("PartitionFilters: [")[1:]]
    assert len(filters) > 1 and all("IN (0,1,2,3,4,5,6,7)" not in f for f in filters)


def test_a_hot_pair_of_blocks_has_a_task_of_its_own(spark):
    rows = [(0, 4000, 500, 8, 4), *((p, 10, 3, 1, 1) for p in range(1, 200))]
    layout = spark.createDataFrame(rows, "part long, n_base long, n_query long, base_blocks int, query_blocks int")
    dealt = {r.part: r for r in knn._dealt(layout, 40, Limits(500, query_block_rows=125)).collect()}
    tasks = [int(dealt[0].first_task + i * dealt[0].pair_tasks) for i in range(32)]
    assert max(tasks.count(t) for t in tasks) <= 2 and len(set(tasks)) > 20
    assert max(r.first_task for r in dealt.values()) < 40


def block_layout(spark, rows, limits, parts=1, rows_held=10**6):
    sizes = spark.createDataFrame([(p, rows, 2 * rows) for p in range(parts)], "part long, n_base long, n_query long")
    return knn._layout(sizes, limits, rows_held)


def test_copies_of_rows_follow_the_cores(spark):
    """Blocks of a few rows do not copy every row thousands of times: copies per row stay as the table grows."""
    copied = []
    for rows in (10_000, 100_000, 1_000_000):
        r = block_layout(spark, rows, Limits(base_block_rows=150, query_block_rows=250)).first()
        copied.append((rows * r.query_blocks + 2 * rows * r.base_blocks) / rows)
    assert len(set(copied)) == 1 and copied[0] <= 3 * 8
    # Queries that a task cannot hold are cut further; a hot partition gets most of the blocks.
    assert block_layout(spark, 1_000_000, Limits(), rows_held=20_000).first().query_blocks == 100
    sizes = spark.createDataFrame([(0, 90_000, 90_000), (1, 900, 900)], "part long, n_base long, n_query long")
    hot, cold = knn._layout(sizes, Limits(base_block_rows=150, query_block_rows=250), 10**6).sort("part").collect()
    assert hot.base_blocks == hot.query_blocks == 8 and cold.base_blocks == cold.query_blocks == 1


def test_small_blocks_share_tasks(spark):
    limits = Limits(base_block_rows=150, query_block_rows=250)
    sizes = [(p, 12_000, 24_000, 80, 96) for p in range(10)]  # cut as the limits say: 76,800 pairs of blocks
    layout = spark.createDataFrame(sizes, "part long, n_base long, n_query long, base_blocks int, query_blocks int")
    assert knn._block_tasks(layout, limits) < 1000
    assert 64 <= knn._block_tasks(block_layout(spark, 12_000, limits, parts=10), limits) < 200


def test_no_queries_and_no_base(make):
    base, none = make([[1, 2], [3, 4]]), make({}, id_col="qid")
    for strategy in LARGE_FORMS:
        assert knn_join(none, base, 3, strategy=strategy, limits=bounded(strategy)).count() == 0
        empty = make({})
        assert knn_join(make([[1, 2]], id_col="qid"), empty, 3, strategy=strategy, limits=bounded(strategy)).count() == 0


# ---- stored indexes


def jobs_of(spark, name, call):
    """What `call` returns, and how many jobs and tasks it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = call()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup(name)
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    return out, len(jobs), sum(s.numTasks for s in stages if s)


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_index_is_reopened_without_a_rebuild(spark, data, tmp_path, inside, metric):
    base, queries = data
    path = str(tmp_path / "index")
    config = plan.replace(CONFIG, metric=metric, limits=Limits(base_block_rows=77))
    built = plan.build_index(base, config, path=f"{path}/base" if inside else None)
    want = as_lists(plan.search(built, queries))
    plan.save_index(built, path)
    opened, jobs, tasks = jobs_of(spark, f"open-{inside}-{metric}", lambda: plan.load_index(spark, path))
    assert jobs <= 3 and tasks <= 6  # the manifest and the cell map
    assert opened.config == built.config and opened.base.columns == built.base.columns
    assert as_lists(plan.search(opened, queries)) == want
    assert (opened.radii is None) == (metric == "ip")
    with pytest.raises(Exception, match="(?i)exist"):
        plan.save_index(built, path)


def test_unfinished_index_is_not_opened(spark, data, tmp_path):
    with pytest.raises(Exception, match="manifest"):
        plan.load_index(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize("order", ["id", "distance"])
def test_self_exclusion_keeps_the_bound(make, blobs, order):
    base = make(blobs[0][:300])
    config = plan.replace(CONFIG, n_probes=3, exclude_self=True, cells_per_part=2, probe_order=order)
    queries = base.withColumnRenamed("id", "qid")
    index = plan.build_index(base, config)
    routed = {r.qid: r.probes for r in plan.route(index, queries).collect()}
    assert "bound" in plan.route(index, queries).columns
    part = {r.id: r.part for r in index.base.collect()}
    got = as_lists(plan.search(index, queries))
    assert got == brute(blobs[0][:300], blobs[0][:300], 10, allowed=lambda i, j: part[j] in routed[i], exclude_self=True)


# ---- exact search by cell radius


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_cells_left_out_hold_no_neighbour(data, make, blobs, metric, exclude_self):
    base, _ = data
    index = plan.with_radii(plan.build_index(base, plan.replace(CONFIG, metric=metric)))
    queries, asked = make(blobs[0][:80], id_col="qid"), blobs[0][:80]
    found, cells = knn_cells_exact(
        queries, index.base, index.centroids, 5, metric, index.radii, exclude_self=exclude_self, with_cells=True
    )
    assert as_lists(found) == brute(asked, blobs[0], 5, metric, exclude_self=exclude_self)
    searched = [r.cells for r in cells.collect()]
    assert len(searched) == 80 and np.mean(searched) < 20  # of 24
    assert as_lists(plan.search_exact(index, queries, plan.replace(index.config, k=5, exclude_self=exclude_self))) == as_lists(found)


def test_radii(make, spark):
    base = make([[1, 0], [3, 0], [0, 0], [0, 5]], cell=[0, 0, 1, 7]).unionByName(
        make({9: None, 10: [float("nan"), 0]}, cell=[0, 0]))
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [9.0, 9.0])], "cell int, centroid array<double>")
    rows = {r.cell: (r.radius, r.n) for r in cell_radii(base, centers).collect()}
    assert rows == {0: (2.0, 4), 1: (0.0, 1), 7: (None, 1)}
    angles = {r.cell: r.radius for r in cell_radii(base, centers, "cosine").collect()}
    assert angles[0] == pytest.approx(0) and angles[1] is None and angles[7] is None
    with pytest.raises(ValueError, match="l2 and cosine"):
        cell_radii(base, centers, "ip")


def test_cells_without_centroid_or_number_are_searched(make, spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 3)).astype(np.float32)
    base = make(rows, cell=[i % 6 for i in range(60)]).withColumn("cell", F.when(F.col("cell") < 5, F.col("cell")))
    centers = spark.createDataFrame([(c, [float(c), 0.0, 0.0]) for c in range(3)], "cell int, centroid array<double>")
    queries = make(rows[:9], id_col="qid")
    for metric in ("l2", "cosine"):
        assert as_lists(knn_cells_exact(queries, base, centers, 4, metric)) == brute(rows[:9], rows, 4, metric)
    # Fewer rows than asked for: every cell is searched.
    assert as_lists(knn_cells_exact(queries, base, centers, 100)) == brute(rows[:9], rows, 100, "l2")
    none = make({0: None}, id_col="qid")
    assert knn_cells_exact(none, base, centers, 3).count() == 0


def test_too_many_cells_to_weigh(data, monkeypatch, blobs):
    from vecframe.operators import exact_cells

    base, queries = data
    index = plan.build_index(base, plan.replace(CONFIG, metric="l2"))
    monkeypatch.setattr(exact_cells, "_CELLS", 3)
    assert as_lists(plan.search_exact(index, queries)) == brute(blobs[1], blobs[0], 10, "l2")
