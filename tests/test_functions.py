import math

import pytest
from pyspark.sql import functions as F

from vecframe.functions import arrays, distance


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} array<double>" for n in values))
    return row.select(column.alias("x")).first()["x"]


def test_distances(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 0.0, 1.0]
    assert one(spark, distance.cosine_distance("a", "b"), a=a, b=b) == pytest.approx(1 - 4 / (3 * math.sqrt(5)))
    assert one(spark, distance.l2_distance("a", "b"), a=a, b=b) == pytest.approx(math.sqrt(6))
    assert one(spark, distance.ip_distance("a", "b"), a=a, b=b) == pytest.approx(-3)


def test_cosine_edges(spark):
    assert one(spark, distance.cosine_distance("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert one(spark, distance.cosine_distance("a", "a"), a=[0.1, 0.7, 0.3]) >= 0.0


def test_max_normalize(spark):
    assert one(spark, arrays.max_normalize("a"), a=[-4.0, 2.0]) == [-1.0, 0.5]
    assert one(spark, arrays.max_normalize("a"), a=[0.0, 0.0]) == [0.0, 0.0]


def test_truncate(spark):
    assert one(spark, arrays.truncate_vector("a"), a=[1.9, -1.9]) == [1, -1]


@pytest.mark.parametrize(
    "named, k, parts, expected",
    [
        ([5], 3, 10, [5, 0, 1]),
        ([7, 2, 9, 4], 3, 10, [2, 4, 7]),
        ([1], 5, 3, [1, 0, 2]),
        ([], 2, 3, [0, 1]),
        ([3, 3, 1, 1], 2, 4, [1, 3]),
    ],
)
def test_unique_refill(spark, named, k, parts, expected):
    row = spark.createDataFrame([(named,)], "p array<int>")
    assert row.select(arrays.unique_refill("p", k, parts).alias("x")).first()["x"] == expected


def test_refill_keeps_order(spark):
    row = spark.createDataFrame([([7, 2],)], "p array<int>")
    assert row.select(arrays.refill("p", 4, 10).alias("x")).first()["x"] == [7, 2, 0, 1]
    assert row.select(F.size(arrays.refill("p", 4, 10)).alias("x")).first()["x"] == 4
