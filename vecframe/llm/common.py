"""Helpers shared by the operators: free column names, digests, sizes, shards of small arrays."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until `df` has no such column (names compare in lower case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo `parts`, equals `part`; a null id is held out never."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def slices_of(batch, column: str, most: int):
    """`batch` (Arrow) in slices whose strings in `column` have about `most` bytes, but for a single longer one."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    # Each row belongs to the slice in which it ends.
    cut = np.cumsum(size, dtype=np.int64) // most
    starts = np.flatnonzero(np.diff(cut, prepend=-1)).tolist()
    for start, stop in zip(starts, [*starts[1:], len(size)], strict=True):
        yield batch.slice(start, stop - start)
