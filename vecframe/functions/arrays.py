"""Column expressions over vectors and partition lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def max_normalize(vector) -> Column:
    """Divide a vector by its largest absolute value; an all-zero vector stays as it is."""
    v = _col(vector).cast("array<double>")
    peak = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(v, lambda x: x / peak)).otherwise(v)


def truncate_vector(vector) -> Column:
    """Drop the fraction of every component, rounding toward zero."""
    return F.transform(_col(vector), lambda x: x.cast("int"))


def refill(parts, k: int, n_parts: int) -> Column:
    """First `k` entries of `parts`, topped up with the lowest partitions not named in it."""
    kept = _col(parts).cast("array<int>")
    spare = F.array_except(F.sequence(F.lit(0), F.lit(n_parts - 1)), kept)
    return F.slice(F.concat(kept, spare), 1, k)


def unique_refill(parts, k: int, n_parts: int) -> Column:
    """Distinct partitions in ascending order, cut or topped up to `k` of them."""
    return refill(F.array_sort(F.array_distinct(_col(parts))), k, n_parts)
