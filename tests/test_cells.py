"""Sampling, clustering, packing."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecframe.operators import clustering as cl
from vecframe.operators import packing, sampling


def test_train_prefix(make):
    kept = sampling.train_prefix(make(np.ones((45, 2))), 0.05)
    assert sorted(r.id for r in kept.collect()) == [0, 1]
    assert sampling.train_prefix(make(np.ones((45, 2))), 0.01).count() == 0
    assert sampling.train_prefix(make({}), 0.5).count() == 0


@pytest.mark.parametrize("ids", [
    [1_000_000 + 7 * i for i in range(200)],
    [1_000_000 + i * i for i in range(150)] + [1_000_100] * 50,
    [5] * 40 + [6], [-(2**63), -3, 0, 4, 2**63 - 1], [3, None, 9, None, 1, 2],
])
@pytest.mark.parametrize("rate", [0.05, 0.5, 1.0])
def test_train_prefix_over_gaps_and_repeats(spark, ids, rate):
    table = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    present = sorted(i for i in ids if i is not None)
    n = int(len(present) * rate)
    wanted = [i for i in present if n and i <= present[n - 1]]
    assert sorted(r.id for r in sampling.train_prefix(table, rate).collect()) == wanted
    if n:
        assert sampling.nth_id(table, n, present[0], present[-1], buckets=3) == present[n - 1]


@pytest.mark.parametrize("ranked_rows", [10_000, 30, 2])
def test_sample_per_cell(spark, ranked_rows):
    """One cell holds half of the rows; the slices must not change what is taken."""
    n, rate = 1500, 0.07
    cell = [0 if i % 2 else 1 + (i // 2) % 5 for i in range(n)]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cell)], "id long, cell int").repartition(4)
    got = {r.id for r in sampling.sample_per_cell(rows, rate, ranked_rows=ranked_rows).collect()}
    want = set()
    for c in set(cell):
        ids = sorted(
            (i for i in range(n) if cell[i] == c), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)
        )
        want |= set(ids[:round(len(ids) * rate)])
    assert got == want


def test_sample_of_tiny_cells_is_empty(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1)], "id long, cell int")
    assert sampling.sample_per_cell(rows, 0.05).count() == 0


def test_bernoulli_is_repeatable(spark):
    rows = spark.range(4000).withColumn("cell", (F.col("id") % 3).cast("int"))
    a = {r.id for r in sampling.sample_bernoulli(rows, 0.25, seed=7).collect()}
    assert a == {r.id for r in sampling.sample_bernoulli(rows, 0.25, seed=7).collect()}
    assert 800 < len(a) < 1200


def test_bernoulli_does_not_depend_on_the_layout(spark):
    rows = spark.range(4000)
    a = {r.id for r in sampling.sample_bernoulli(rows.repartition(3), 0.25).collect()}
    assert a == {r.id for r in sampling.sample_bernoulli(rows.coalesce(1), 0.25).collect()}


def test_strata_have_fractions_of_their_own(spark):
    rows = spark.range(4000).withColumn("s", F.when(F.col("id") % 4 < 3, F.col("id") % 4)).withColumn("_stratum", F.lit(1))
    every = sampling.stratum_fractions(rows, "s", 0.5)
    assert sorted((r.s is None, r.s, r.fraction) for r in every.where("s is not null").collect()) == [
        (False, 0, 0.5), (False, 1, 0.5), (False, 2, 0.5)]
    assert every.where("s is null").count() == 1
    some = spark.createDataFrame([(0, 0.0), (1, 1.0), (None, 0.25), (1, 1.0)], "s long, fraction double")
    kept = sampling.sample_bernoulli(rows, 0.5, stratum="s", fractions=some)
    assert kept.columns == rows.columns
    n = {r.s: r["count"] for r in kept.groupBy("s").count().collect()}
    assert 0 not in n and n[1] == 1000 and 400 < n[2] < 600 and 180 < n[None] < 320
    alike = sampling.sample_bernoulli(rows, 0.1, stratum="s", fractions=sampling.stratum_fractions(rows, "s", 0.5))
    assert {r.id for r in alike.collect()} == {r.id for r in sampling.sample_bernoulli(rows, 0.5).collect()}
    with pytest.raises(ValueError, match="stratum"):
        sampling.sample_bernoulli(rows, 0.5, fractions=some)


def test_packing_ends_without_a_claim():
    assert sorted(packing.pack([[0], [1, 2]], [1, 10, 1])) == [0, 0, 1]


def test_assign_and_count_with_empty_cell(spark, make):
    base = make({0: [0, 0], 1: [9, 9], 2: [5, 5], 3: None, 4: [1, 0]})
    centers = cl.centroid_table(spark, [[0, 0], [10, 10], [-50, -50]])
    assigned = cl.assign_cells(base, centers)
    assert {r.id: r.cell for r in assigned.collect()} == {0: 0, 1: 1, 2: 0, 3: None, 4: 0}
    counts = cl.cell_counts(assigned, 4)
    assert {r.cell: r.n for r in counts.collect()} == {0: 3, 1: 1, 2: 0, 3: 0}


def test_large_model_is_joined(spark, make, monkeypatch, blobs):
    centers = cl.centroid_table(spark, blobs[0][:20])
    small = cl.assign_cells(make(blobs[1]), centers).collect()
    monkeypatch.setattr(cl, "_MODEL_ROWS", 5)
    large = cl.assign_cells(make(blobs[1]), centers).collect()
    assert {r.id: r.cell for r in small} == {r.id: r.cell for r in large}


def test_mean_vectors(make):
    rows = cl.mean_vectors(make([[1, 1], [3, 5], [7, 7]], g=[0, 0, 2]), "g").collect()
    assert {r.cell: r.centroid for r in rows} == {0: [2.0, 3.0], 2: [7.0, 7.0]}


def test_lloyd_matches_numpy(spark, make, blobs):
    base = blobs[0].astype(np.float64)
    centers = base[:6].copy()
    centers[5] = 1e4  # loses all rows, must stay
    want = centers.copy()
    for _ in range(3):
        cell = ((base[:, None] - want[None]) ** 2).sum(2).argmin(1)
        for c in range(6):
            if (cell == c).any():
                want[c] = base[cell == c].mean(0)
    got = cl.kmeans_lloyd(make(blobs[0]).repartition(4), cl.centroid_table(spark, centers), 3)
    values = np.array([r.centroid for r in sorted(got.collect())])
    np.testing.assert_allclose(values, want, atol=1e-6)


def test_library_fits(make, blobs):
    base = make(blobs[0])
    model = cl.fit_kmeans(base, 8, seed=1)
    cells = cl.attach_cells(base, model)
    assert cells.columns == ["id", "features", "cell"]
    nearest = cl.assign_cells(base, cl.centroid_table(base.sparkSession, model.clusterCenters()), column="near")
    assert cells.join(nearest.select("id", "near"), "id").where("cell <> near").count() == 0
    fine, coarse = cl.fit_two_levels(base, 2, 10, train_rate=0.3)
    assert fine.count() == 10 and coarse.count() == 2


def test_rank_cells(spark):
    coarse = cl.centroid_table(spark, [[1, 0], [0, 1]])
    fine = cl.centroid_table(spark, [[1, 1], [1, 0.1], [2, 2], [0, 3]])
    rows = sorted(cl.rank_cells(coarse, fine).collect(), key=lambda r: (r.coarse, r["rank"]))
    assert [r.cell for r in rows] == [1, 0, 2, 3, 3, 0, 2, 1]


def test_zero_centroids_rank_last(spark):
    coarse = cl.centroid_table(spark, [[1, 0], [0, 0]])
    fine = cl.centroid_table(spark, [[0, 0], [0, 1], [1, 1]])
    ranks = cl.rank_cells(coarse, fine)
    rows = sorted(ranks.collect(), key=lambda r: (r.coarse, r["rank"]))
    assert [(r.coarse, r.cell, r["rank"]) for r in rows] == [
        (0, 2, 1), (0, 1, 2), (0, 0, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3)
    ]
    counts = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "cell int, n long")
    packed = packing.balance_cells(ranks, counts)
    assert {r.cell: r.part for r in packed.collect()} == {2: 0, 0: 1, 1: 0}


@pytest.mark.parametrize("first", [1, 3, 64])
@pytest.mark.parametrize("bins", [1, 4, 9])
def test_packing_looks_at_near_cells_only(spark, first, bins, monkeypatch):
    """Rankings read as far as they are needed pack as full ones do."""
    rng = np.random.default_rng(bins)
    centers = rng.normal(size=(40, 5))
    centers[7] = centers[21] = 0  # without a distance
    anchors = rng.normal(size=(bins, 5))
    anchors[0] = 0
    coarse, fine = cl.centroid_table(spark, anchors), cl.centroid_table(spark, centers)
    sizes = rng.integers(0, 50, 40)
    counts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "cell int, n long")
    full = {r.cell: r.part for r in packing.balance_cells(cl.rank_cells(coarse, fine), counts).collect()}
    asked, topk = [], packing.TopK
    monkeypatch.setattr(packing, "TopK", lambda ids, v, k, metric: (asked.append(k), topk(ids, v, k, metric))[1])
    near = packing.balance_near(coarse, fine, counts, first=first).collect()
    assert {r.cell: r.part for r in near} == full and [r.n for r in sorted(near, key=lambda r: r.cell)] == sizes.tolist()
    assert min(asked) == first and (first < 64 or max(asked) == 64)


def test_names_of_own_columns_are_free(spark, make, blobs, monkeypatch):
    monkeypatch.setattr(cl, "_MODEL_BYTES", 100)
    monkeypatch.setattr(packing, "_LITERAL_CELLS", 1)
    rows = make(blobs[0][:20]).withColumns({"_row": F.lit(1), "_pos": F.lit(2), "_cell": F.lit(3), "_parts": F.lit(4)})
    model = cl.centroid_table(spark, blobs[0][:7])
    assigned = cl.assign_cells(rows, model)
    assert assigned.columns == [*rows.columns, "cell"] and assigned.where("id < 7 and id <> cell").count() == 0
    lists = assigned.withColumn("cells", F.array("cell", "cell"))
    cell_map = spark.createDataFrame([(i, i + 10) for i in range(7)], "cell int, part int")
    mapped = packing.remap_cell_lists(lists, cell_map, "cells", "parts")
    assert mapped.columns == [*lists.columns, "parts"]
    assert mapped.where("parts <> array(cell + 10, cell + 10) or _row <> 1 or _parts <> 4").count() == 0


def test_lloyd_of_a_large_model(spark, make, blobs, monkeypatch):
    rows, start = make(blobs[0][:400]).repartition(5), cl.centroid_table(spark, blobs[0][:9])
    small = {r.cell: r.centroid for r in cl.kmeans_lloyd(rows, start, 3).collect()}
    monkeypatch.setattr(cl, "_MODEL_BYTES", 100)
    large = {r.cell: r.centroid for r in cl.kmeans_lloyd(rows, start, 3).collect()}
    assert small.keys() == large.keys()
    for c, v in small.items():
        assert np.allclose(v, large[c])


def test_sums_are_passed_on_in_parts(make, blobs, monkeypatch):
    rows = make(blobs[0][:300]).withColumn("g", (F.col("id") % 7).cast("int")).repartition(3)
    whole = {r.cell: r.centroid for r in cl.mean_vectors(rows, "g").collect()}
    monkeypatch.setattr(cl, "_SUM_BYTES", 1)
    parts = {r.cell: r.centroid for r in cl.mean_vectors(rows, "g").collect()}
    assert set(whole) == set(parts) == set(range(7))
    for c in whole:
        assert np.allclose(whole[c], parts[c]) and np.allclose(whole[c], blobs[0][:300][c::7].mean(axis=0), atol=1e-5)


def rule(preference, sizes):
    """The packing rule in its plainest form: a walk over bins, one claim per visit."""
    bins, share = len(preference), sum(sizes) // len(preference)
    owner, load, idle, turn = {}, [0] * bins, 0, 0
    while len(owner) < len(sizes):
        if idle >= bins:
            cell = min(c for c in range(len(sizes)) if c not in owner)
            b = min(range(bins), key=lambda x: (load[x], x))
        else:
            b, turn = turn % bins, turn + 1
            if load[b] >= share:
                idle += 1
                continue
            cell, idle = next(c for c in preference[b] if c not in owner), 0
        owner[cell] = b
        load[b] += sizes[cell]
    return [owner[c] for c in range(len(sizes))]


def test_pack_terminates():
    assert packing.pack([[0, 1, 2], [1, 0, 2]], [1, 1, 1]) == [0, 1, 0]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(0, 50), min_size=1, max_size=15), st.randoms())
def test_pack_follows_the_rule(bins, sizes, random):
    preference = [random.sample(range(len(sizes)), len(sizes)) for _ in range(bins)]
    packed = packing.pack(preference, sizes)
    assert packed == rule(preference, sizes)
    assert len(packed) == len(sizes) and set(packed) <= set(range(bins))


def test_balance_sweep_and_maps(spark):
    ranks = spark.createDataFrame(
        [(c, q, cell, r + 1) for c, pref in ((2, [[0, 1, 2], [1, 0, 2]]), (1, [[2, 1, 0]]))
         for q, cells in enumerate(pref) for r, cell in enumerate(cells)],
        "bins int, coarse int, cell int, rank int",
    )
    counts = spark.createDataFrame([(b, c, 1) for b in (1, 2) for c in range(3)], "bins int, cell int, n long")
    rows = packing.balance_cells(ranks, counts, config="bins").collect()
    assert {(r.bins, r.cell): r.part for r in rows} == {
        (2, 0): 0, (2, 1): 1, (2, 2): 0, (1, 0): 0, (1, 1): 0, (1, 2): 0
    }
    packed = packing.balance_cells(ranks.where("bins = 2").drop("bins"), counts.where("bins = 2").drop("bins"))
    cell_map = packing.cell_to_part(packed, 5)
    assert {r.cell: r.part for r in cell_map.collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    lists = spark.createDataFrame([([1, 1, 4, 2],)], "cells array<int>")
    assert packing.remap_cell_lists(lists, cell_map, "cells", "parts").first().parts == [1, 1, 0, 0]
    rows = spark.createDataFrame([(1,), (1,), (4,)], "cell int")
    sizes = packing.part_sizes(packing.remap_cells(rows, cell_map), 3)
    assert {r.part: r.n for r in sizes.collect()} == {0: 1, 1: 2, 2: 0}


def test_hot_cell_is_written_as_several_files(spark, tmp_path):
    """A cell with most of the rows must not become one task."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50k")
    try:
        rows = spark.range(40_000, numPartitions=8).select(
            "id", F.array(*[F.rand(i) for i in range(4)]).alias("features"),
            F.when(F.col("id") % 10 < 7, 3).otherwise(F.col("id") % 3).cast("int").alias("cell"),
        )
        back = packing.write_by_cell(rows, str(tmp_path / "cells"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert back.count() == 40_000 and back.columns == ["id", "features", "cell"]
    assert len(list((tmp_path / "cells" / "cell=3").glob("*.parquet"))) > 3


def test_large_models_give_the_same_rows_by_join(spark, make, blobs, monkeypatch):
    from vecframe.operators import clustering, packing

    rows = make(blobs[0][:200])
    twice = rows.unionByName(rows).withColumnRenamed("id", "qid")
    model = clustering.centroid_table(spark, blobs[0][:7])
    lists = spark.createDataFrame([([0, 2, 2, 9],), ([],), (None,)], "cells array<int>")
    cell_map = spark.createDataFrame([(0, 4), (1, 5), (2, 6)], "cell int, part int")

    def results():
        cells = clustering.assign_cells(twice, model).select("qid", "cell").collect()
        mapped = packing.remap_cell_lists(lists, cell_map, "cells", "parts").select("parts").collect()
        return sorted(map(tuple, cells)), sorted(map(str, mapped))

    small = results()
    assert len(small[0]) == 400
    monkeypatch.setattr(clustering, "_MODEL_BYTES", 100)
    monkeypatch.setattr(packing, "_LITERAL_CELLS", 2)
    assert results() == small
