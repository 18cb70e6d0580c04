"""Distances between two vector columns, as plain column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(vector) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_total(F.transform(_double(a), lambda x: x * x)))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b), never below 0; NULL when either vector has zero length."""
    similarity = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(similarity.isNotNull(), F.greatest(1 - similarity, F.lit(0.0)))


def l2_distance(a, b) -> Column:
    return F.sqrt(_total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def ip_distance(a, b) -> Column:
    """1 - a·b."""
    return 1 - dot(a, b)


DISTANCES = {"cosine": cosine_distance, "l2": l2_distance, "ip": ip_distance}
