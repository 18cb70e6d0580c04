import types

import pytest

from vecframe import session


def test_shared_dir_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named.rstrip("/")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_a_cluster_without_shared_dir_is_refused():
    nothing = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(types.SimpleNamespace(sparkContext=context, conf=nothing))


def test_model_table_is_broadcast_only_within_its_limit(spark):
    big = spark.range(1000, numPartitions=2).withColumnRenamed("id", "k")
    small = spark.range(50).withColumnRenamed("id", "k")
    plan = big.join(session.model_table(small, 100), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert session.model_table(small, 10) is small


def test_write_and_read(spark):
    rows = spark.range(7).withColumnRenamed("id", "n")
    assert sorted(session.write_and_read(rows, "t").collect()) == sorted(rows.collect())


def test_intermediate_tables_can_be_removed(spark):
    from vecframe import session

    before = list(session._own)
    session._own.clear()
    first = session.write_and_read(spark.range(5), "one")
    assert first.count() == 5
    path = session._own[0]
    assert session.remove_intermediate(spark) == 1 and session.remove_intermediate(spark) == 0
    assert session.fresh_path(spark, "two") != path
    assert session.remove_intermediate(spark) == 0  # named, never written
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(path)
    session._own.extend(before)


def test_wide_tables_stay_distributed(spark, monkeypatch):
    from pyspark.sql import functions as F

    table = spark.range(3000).select("id", F.array_repeat("id", 100).alias("v"))

    def sent(*limits):
        return "broadcast" in session.model_table(table, *limits)._jdf.queryExecution().logical().toString().lower()

    assert sent() and not sent(2999) and not sent(10)
    monkeypatch.setattr(session, "MODEL_BYTES", 1_000_000)  # of 2.4 million
    assert not sent()
    monkeypatch.setattr(session, "MODEL_BYTES", 4_000_000)
    assert sent()
