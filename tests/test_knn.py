import re

import numpy as np
import pytest
from conftest import as_lists, brute
from pyspark.sql import functions as F

from vecframe.operators import knn
from vecframe.operators.knn import Limits, knn_join

FORMS = ("broadcast_queries", "broadcast_base", "query_groups", "blocks")


def small(strategy):
    """Limits that cut small tables into several blocks or groups."""
    size = 1500 if strategy == "query_groups" else 32 << 20
    return Limits(broadcast_bytes=size, base_block_rows=200, query_block_rows=25)



@pytest.fixture(scope="module")
def tables(make, blobs):
    base, asked = blobs
    part = [int(x) for x in np.where(np.arange(len(base)) % 3 == 0, 0, np.arange(len(base)) % 7)]
    probes = [[i % 7, (i + 2) % 7, i % 7] for i in range(len(asked))]
    return (
        make(base, part=part).repartition(5).cache(),
        make(asked, id_col="qid", probes=probes).cache(),
        part, probes,
    )


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("strategy", FORMS)
def test_exact(tables, blobs, strategy, metric):
    base, queries, _, _ = tables
    got = knn_join(queries, base, 10, metric, strategy=strategy, limits=small(strategy))
    assert as_lists(got) == brute(blobs[1], blobs[0], 10, metric)


@pytest.mark.parametrize("strategy", FORMS)
def test_pruned_with_a_hot_partition(tables, blobs, strategy):
    """Partition 0 holds more than a third of the base."""
    base, queries, part, probes = tables
    got = knn_join(queries, base, 10, probes="probes", strategy=strategy, limits=small(strategy))
    assert as_lists(got) == brute(blobs[1], blobs[0], 10, allowed=lambda i, j: part[j] in probes[i])


@pytest.mark.parametrize("strategy", FORMS)
def test_per_part(tables, blobs, strategy):
    base, queries, part, probes = tables
    got = knn_join(queries, base, 4, probes="probes", per_part=True, strategy=strategy, limits=small(strategy))
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r.qid, r.part, r.rank)):
        rows.setdefault((r.qid, r.part), []).append(r.neighbor)
    for p in range(7):
        want = brute(blobs[1], blobs[0], 4, allowed=lambda i, j: part[j] == p)
        for i, lists in enumerate(probes):
            if p in lists:
                assert rows.pop((i, p)) == want[i]
    assert not rows


def test_auto_uses_the_form_for_two_large_sides(tables, blobs):
    base, queries, _, _ = tables
    tiny = Limits(broadcast_bytes=1000, base_block_rows=400, query_block_rows=30, query_groups=1)
    got = knn_join(queries, base, 5, limits=tiny)
    assert "side" in got._jdf.queryExecution().toString()
    assert as_lists(got) == brute(blobs[1], blobs[0], 5)


@pytest.mark.parametrize("strategy", FORMS)
def test_hot_copies(make, strategy):
    """A third of the base and of the queries are the same vector."""
    rng = np.random.default_rng(3)
    base, asked = rng.normal(size=(900, 6)).astype(np.float32), rng.normal(size=(90, 6)).astype(np.float32)
    base[::3], asked[::3] = 1, 1
    got = knn_join(make(asked, id_col="qid"), make(base), 6, strategy=strategy, limits=small(strategy))
    assert as_lists(got) == brute(asked, base, 6)


@pytest.mark.parametrize("strategy", FORMS)
def test_self_join(make, strategy):
    vectors = np.random.default_rng(4).normal(size=(40, 5)).astype(np.float32)
    base, queries = make(vectors), make(vectors, id_col="qid")
    plain = knn_join(queries, base, 3, strategy=strategy)
    first = plain.where("rank = 1").collect()
    assert all(r.neighbor == r.qid and r.distance == pytest.approx(0, abs=1e-12) for r in first)
    without = knn_join(queries, base, 3, exclude_self=True, strategy=strategy)
    assert as_lists(without) == brute(vectors, vectors, 3, exclude_self=True)


def test_ties_nulls_and_short_lists(make):
    base = make({4: [1, 1], 2: [1, 1], 9: [0, 0], 7: None, 5: [1, -1]})
    queries = make({0: [1, 1], 1: [0, 0], 2: None}, id_col="qid")
    for strategy in (*FORMS, "auto"):
        assert as_lists(knn_join(queries, base, 10, strategy=strategy)) == {0: [2, 4, 5]}


def test_bound_column(tables, blobs):
    base, queries, _, _ = tables
    exact = knn_join(queries, base, 5)
    bounded = queries.join(exact.where("rank = 5").select("qid", F.col("distance").alias("far")), "qid")
    for strategy in FORMS:
        got = knn_join(bounded, base, 5, bound="far", strategy=strategy, limits=small(strategy))
        assert as_lists(got) == brute(blobs[1], blobs[0], 5)


def test_plan_prunes_stored_partitions(spark, tables, tmp_path):
    base, queries, _, _ = tables
    base.write.partitionBy("part").parquet(str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    few = queries.where("qid < 2").withColumn("probes", F.array(F.lit(1), F.lit(4)))
    plan = knn_join(few, stored, 3, probes="probes")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*IN \(1,4\)", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_views(make):
    base = make([[1, 0], [0, 1], [1, 1]], label=[7, 8, 9])
    queries = make({5: [1, 0.1], 3: [0, 0]}, id_col="qid")
    found = knn_join(queries, base, 2)
    nested = knn.as_predictions(found, queries)
    rows = {r.qid: r.prediction for r in nested.collect()}
    assert [p.neighbor for p in rows[5]] == [0, 2] and rows[3] == []
    assert [r.qid for r in knn.ordered_result(nested).collect()] == [3, 5]
    assert {r.qid: r.neighbors for r in knn.neighbor_ids(nested).collect()} == {5: [0, 2], 3: []}
    labels = knn.lookup_labels(found, base, "label").collect()
    assert [(r.qid, r.labels) for r in labels] == [(5, [7, 9])]


def test_topk_per_query(spark):
    rows = [(1, 5, 0.3), (1, 4, 0.3), (1, 6, 0.1), (2, 9, 0.5)]
    candidates = spark.createDataFrame(rows, "qid long, neighbor long, distance double")
    assert as_lists(knn.topk_per_query(candidates, 2)) == {1: [6, 4], 2: [9]}


def test_forced_broadcast_is_checked(tables):
    base, queries, _, _ = tables
    for strategy in ("broadcast_queries", "broadcast_base"):
        with pytest.raises(ValueError, match="larger than"):
            knn_join(queries, base, 3, strategy=strategy, limits=Limits(broadcast_bytes=100))


@pytest.mark.parametrize("strategy", FORMS)
def test_carry_and_many_partitions(make, strategy):
    """More than 64 partitions, mixed within the stored rows."""
    rng = np.random.default_rng(8)
    vectors, asked = rng.normal(size=(800, 4)).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32)
    part = [int(x) for x in rng.integers(0, 150, 800)]
    probes = [[int(x) for x in rng.choice(150, 40, replace=False)] for _ in range(30)]
    got = knn_join(
        make(asked, id_col="qid", probes=probes), make(vectors, part=part), 5,
        probes="probes", carry="part", strategy=strategy, limits=small(strategy),
    )
    assert as_lists(got) == brute(asked, vectors, 5, allowed=lambda i, j: part[j] in probes[i])
    assert all(r.tag == part[r.neighbor] for r in got.collect())
