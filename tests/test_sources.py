import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.sources import tables, vecs


def dump(path, rows, dtype):
    """The file format, written by hand."""
    with open(path, "wb") as f:
        for row in rows:
            f.write(np.int32(len(row)).tobytes() + np.asarray(row, dtype=dtype).tobytes())


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_fvecs_in_several_splits(spark, tmp_path):
    rows = np.random.default_rng(0).normal(size=(1000, 16)).astype(np.float32)
    dump(tmp_path / "a.fvecs", rows, "<f4")
    df = vecs.read_fvecs(spark, str(tmp_path / "a.fvecs"), splitBytes=10_000)
    assert df.rdd.getNumPartitions() == 7
    assert by_id(df, "features") == {i: r.tolist() for i, r in enumerate(rows)}


def test_both_ways_of_reading_agree(spark, tmp_path):
    rows = np.random.default_rng(7).normal(size=(700, 5)).astype(np.float32)
    dump(tmp_path / "a.fvecs", rows, "<f4")
    dump(tmp_path / "a.ivecs", [[3, 1], [2, 7]], "<i4")
    got = vecs.read_fvecs(spark, str(tmp_path / "a.fvecs"), through="hadoop")
    assert by_id(got, "features") == {i: r.tolist() for i, r in enumerate(rows)}
    got = vecs.read_ivecs(spark, str(tmp_path / "a.ivecs"), through="hadoop")
    assert by_id(got, "neighbors") == {0: [3, 1], 1: [2, 7]}


def test_ivecs(spark, tmp_path):
    dump(tmp_path / "a.ivecs", [[3, 1], [2, 7]], "<i4")
    assert by_id(vecs.read_ivecs(spark, str(tmp_path / "a.ivecs")), "neighbors") == {0: [3, 1], 1: [2, 7]}


def test_normalized_scans(spark, tmp_path):
    dump(tmp_path / "a.fvecs", [[-4, 2], [0, 0]], "<f4")
    dump(tmp_path / "a.ivecs", [[4, 2]], "<i4")
    assert by_id(vecs.read_fvecs(spark, str(tmp_path / "a.fvecs"), normalize=True), "features") == {
        0: [-1.0, 0.5], 1: [0.0, 0.0]
    }
    assert by_id(vecs.read_ivecs(spark, str(tmp_path / "a.ivecs"), normalize=True), "neighbors") == {0: [1.0, 0.5]}


def test_bad_header_names_the_record(spark, tmp_path):
    rows = np.ones((6, 4), dtype="<i4")
    rows[:, 0] = 3
    rows[4, 0] = 2
    rows.tofile(tmp_path / "bad.fvecs")
    with pytest.raises(Exception, match="record 4 has length 2, expected 3"):
        vecs.read_fvecs(spark, str(tmp_path / "bad.fvecs")).collect()
    with pytest.raises(Exception, match="record 4 has length 2, expected 3"):
        vecs.read_fvecs(spark, str(tmp_path / "bad.fvecs"), through="hadoop").collect()
    rows.reshape(-1)[:-1].tofile(tmp_path / "cut.fvecs")
    with pytest.raises(Exception, match="not a multiple"):
        vecs.read_fvecs(spark, str(tmp_path / "cut.fvecs")).collect()


def test_write_and_read_back_in_order(spark, make, tmp_path):
    rows = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        vecs.write_fvecs(make(rows).repartition(3), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert by_id(vecs.read_fvecs(spark, str(tmp_path / "out")), "features") == {
        i: r.tolist() for i, r in enumerate(rows)
    }


def test_read_dataset(spark, make, tmp_path):
    dump(tmp_path / "b.fvecs", [[1, 2], [3, 4]], "<f4")
    dump(tmp_path / "q.fvecs", [[1, 2]], "<f4")
    dump(tmp_path / "t.ivecs", [[0, 1]], "<i4")
    data = tables.read_dataset(spark, *(str(tmp_path / n) for n in ("b.fvecs", "q.fvecs", "t.ivecs")))
    assert data.base.count() == 2 and data.learn is None
    assert data.queries.columns == ["qid", "features"]
    assert data.truth.schema.simpleString() == "struct<qid:bigint,neighbors:array<bigint>>"
    make([[1, 2]]).write.parquet(str(tmp_path / "p"))
    again = tables.read_dataset(
        spark, str(tmp_path / "p"), str(tmp_path / "p"), str(tmp_path / "t.ivecs"), learn=str(tmp_path / "p")
    )
    assert again.queries.columns == ["qid", "features"] and again.learn.count() == 1


def test_row_ids_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(5000).select(F.concat(F.lit("row-"), "id").alias("name")).repartitionByRange(6, "name").write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = tables.with_row_id(spark.read.text(path), "n")
        assert rows.rdd.getNumPartitions() > 6
        got = {r.n: r.value for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [line for f in sorted((tmp_path / "many").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == dict(enumerate(lines))


def test_zip_join(spark, tmp_path):
    spark.range(300).select((F.col("id") * 2).alias("a")).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(200).select((F.col("id") * 3).alias("b")).coalesce(1).write.parquet(str(tmp_path / "b"))
    zipped = tables.zip_join(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")))
    assert zipped.columns == ["id", "a", "b"]
    assert zipped.count() == 200 and zipped.where("a <> id * 2 or b <> id * 3").count() == 0


def test_assignment_shorter_than_base(spark, make, tmp_path):
    (tmp_path / "cells.csv").write_text("2\n1\n3\n")
    got = tables.load_assignment(make(np.ones((5, 2))), str(tmp_path / "cells.csv"))
    assert by_id(got, "cell") == {0: 2, 1: 1, 2: 3, 3: 0, 4: 0}


def test_model_round_trip(spark, make, tmp_path):
    from vecframe.operators.clustering import assign_cells, centroid_table

    base = make(np.random.default_rng(2).normal(size=(50, 4)))
    fine = centroid_table(spark, np.random.default_rng(3).normal(size=(5, 4)))
    coarse = centroid_table(spark, np.random.default_rng(4).normal(size=(2, 4)))
    cells = assign_cells(base, fine)
    tables.save_model(str(tmp_path / "m"), cells, fine, coarse)
    got, fine2, coarse2 = tables.load_model(base, str(tmp_path / "m"))
    assert by_id(got, "cell") == by_id(cells, "cell")
    assert sorted(fine2.collect()) == sorted(fine.collect())
    assert sorted(coarse2.collect()) == sorted(coarse.collect())
    first = next((tmp_path / "m" / "centroids1").glob("part-*")).read_text().splitlines()
    assert len(first) == 2 and len(first[0].split(",")) == 4


@pytest.mark.parametrize("form", ["text", "parquet"])
def test_row_ids_do_not_depend_on_the_splits_of_a_job(spark, tmp_path, form):
    path = str(tmp_path / form)
    spark.range(40000).select(F.col("id").cast("string").alias("value")).coalesce(1).write.format(form).save(path)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        rows = tables.with_row_id(spark.read.format(form).load(path), "n")
        for splits in ("3", "7"):
            spark.conf.set("spark.sql.files.minPartitionNum", splits)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
            assert rows.count() == 40000
            assert rows.where("n <> cast(value as long)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_positional_rules_refuse_other_ids(make, spark, tmp_path):
    from vecframe.operators.clustering import centroid_table
    from vecframe.operators.sampling import train_prefix

    shifted = make(np.ones((5, 2))).withColumn("id", F.col("id") + 100)
    with pytest.raises(ValueError, match="must run from 0"):
        tables.save_assignment(shifted.withColumn("cell", F.lit(1)), str(tmp_path / "a"))
    (tmp_path / "cells.csv").write_text("2\n1\n3\n")
    with pytest.raises(ValueError, match="must run from 0"):
        tables.load_assignment(shifted, str(tmp_path / "cells.csv"))
    assert sorted(r.id for r in train_prefix(shifted, 0.5).collect()) == [100, 101]
    with pytest.raises(ValueError, match="must run from 0"):
        tables.save_centroids(centroid_table(spark, np.ones((2, 2)), [0, 2]), str(tmp_path / "c"))


def planned(df):
    """How many tasks a scan has."""
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("condition, ids", [
    ("id < 40", range(40)), ("id <= 40 and id > 35", range(36, 41)), ("id = 77", [77]), ("40 > id and id >= 38", [38, 39]),
    ("id in (3, 90, 5)", [3, 5, 90]), ("id = 500", []), ("id < 0", []), ("id > 5 and id < 5", []), ("id in (null)", []),
    ("id < 10 or id > 95", [*range(10), *range(96, 100)]), ("id != 50 and id >= 49", range(49, 100)[:1]), ("id is null", []),
])
def test_conditions_on_id_reach_the_scan(spark, tmp_path, condition, ids):
    rows = np.arange(400, dtype=np.float32).reshape(100, 4)
    for i in range(4):  # a folder of four files, ten records a split
        dump(tmp_path / f"{i}.fvecs", rows[25 * i:25 * i + 25], "<f4")
    df = vecs.read_fvecs(spark, str(tmp_path), splitBytes=200)
    assert planned(df) == 12 and vecs.count_records(str(tmp_path)) == 100
    got = df.where(condition)
    wanted = [*ids, *range(51, 100)] if condition.startswith("id != 50") else list(ids)
    assert by_id(got, "features") == {i: rows[i].tolist() for i in wanted}
    if condition in ("id < 40", "id = 77", "id = 500"):
        assert planned(got) == {"id < 40": 5, "id = 77": 1, "id = 500": 1}[condition]


def test_one_header_is_read(spark, tmp_path):
    dump(tmp_path / "a.fvecs", np.ones((6, 3)), "<f4")
    dump(tmp_path / "b.fvecs", np.ones((7, 2)), "<f4")
    with pytest.raises(ValueError, match="not a multiple"):
        vecs.count_records(str(tmp_path))
    dump(tmp_path / "b.fvecs", np.ones((4, 7)), "<f4")  # as many bytes as eight records of three values
    with pytest.raises(Exception, match="has length 7, expected 3"):
        vecs.read_fvecs(spark, str(tmp_path)).collect()


def test_plain_format_without_conditions(spark, tmp_path):
    dump(tmp_path / "a.fvecs", np.ones((6, 3)), "<f4")
    vecs.register(spark)
    assert spark.read.format("fvecs").load(str(tmp_path / "a.fvecs")).where("id < 2").count() == 2


@pytest.mark.parametrize("ids", [[0, 1, 1, 3], [0, 0, 2], [0, 2, 2, 2, 4, 5, 5], [0, 1, None, 3], [2**62, 2**62 + 1, 2**62 + 2]])
def test_repeated_positions_are_noticed(spark, ids):
    with pytest.raises(ValueError, match="must run from 0"):
        tables.check_dense(spark.createDataFrame([(i,) for i in ids], "id long"))


def test_positions_once_each(spark):
    assert tables.check_dense(spark.range(1000)) == 1000 and tables.check_dense(spark.range(0)) == 0
