"""fvecs / ivecs files as Spark data sources.

    spark.read.format("fvecs").load(path)     id bigint, features array<float>
    spark.read.format("ivecs").load(path)     id bigint, neighbors array<int>
    read_fvecs(spark, path)                   the same, with conditions on id reaching the scan

A record is a little-endian int32 length d followed by d float32 (fvecs) or int32 (ivecs) values,
and every record has the length of the first. Records are therefore at fixed offsets: a file is
cut into byte ranges, each range is read by its own task as Arrow batches, and the positional id
of a record follows from its offset. A folder is read file by file in name order, its ids running
on. `max_normalize` is the normalised form of either scan.

Conditions on `id` reach the scan of `read_fvecs` and `read_ivecs`: byte ranges outside of them are never planned, so `id < n` reads
the first n records and nothing else. One header, that of the first file, is read on the driver;
row counts follow from file sizes, and tasks check the length of every record they read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from vecframe.functions.arrays import max_normalize
from vecframe.session import ship

_SPLIT_BYTES = 128 << 20
_BATCH_BYTES = 4 << 20
# Spark's switch for conditions that Python sources may see.
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open_fs(path: str):
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return pafs.FileSystem.from_uri(path)


@dataclass
class ByteRange(InputPartition):
    path: str
    offset: int  # byte offset of the first record
    records: int
    width: int  # values per record
    first_id: int


class _VecsReader(DataSourceReader):
    def __init__(self, path, dtype, column, split_bytes):
        self.path, self.dtype, self.column, self.split_bytes = path, dtype, column, split_bytes

    def partitions(self):
        return [r for r in self._ranges(*files_of(self.path)) if r.records] or [ByteRange("", 0, 0, 1, 0)]

    def wanted(self, first: int, stop: int) -> tuple[int, int]:
        """The part of the ids from `first` to before `stop` that is to be read."""
        return first, stop

    def _ranges(self, files, width):
        record, next_id = 4 * (width + 1), 0
        step = max(1, self.split_bytes // record)
        for path, size in files:
            total = size // record
            start, stop = self.wanted(next_id, next_id + total)
            for at in range(start, stop, step):
                yield ByteRange(path, (at - next_id) * record, min(step, stop - at), width, at)
            next_id += total

    def read(self, partition):
        if partition.records == 0:
            return
        fs, _ = _open_fs(self.path)
        width = partition.width
        record = 4 * (width + 1)
        step = max(1, _BATCH_BYTES // record)
        with fs.open_input_file(partition.path) as stream:
            for start in range(0, partition.records, step):
                n = min(step, partition.records - start)
                raw = stream.read_at(n * record, partition.offset + start * record)
                rows = np.frombuffer(raw, "<i4").reshape(n, width + 1)
                first = partition.first_id + start
                _check_lengths(rows[:, 0], width, np.arange(first, first + n), partition.path)
                values = np.ascontiguousarray(rows[:, 1:]).view(self.dtype).reshape(-1)
                offsets = np.arange(n + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(first, first + n, dtype=np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(values)),
                    ],
                    names=["id", self.column],
                )


class _FilteringReader(_VecsReader):
    """A reader that plans only the ranges which conditions on `id` leave."""

    least, most = 0, None  # the ids to read, both included

    def pushFilters(self, filters):
        for condition in filters:
            if getattr(condition, "attribute", None) == ("id",):
                self._narrow(condition)
            # Spark checks the rows that are read once more: an In list may have gaps.
            yield condition

    def _narrow(self, condition):
        kind, value = type(condition), getattr(condition, "value", None)
        if kind is EqualTo:
            self._within(value, value)
        elif kind is In:
            # A list without any value that is not null matches no row.
            present = [v for v in value if v is not None]
            self._within(min(present, default=0), max(present, default=-1))
        elif kind is LessThan:
            self._within(0, value - 1)
        elif kind is LessThanOrEqual:
            self._within(0, value)
        elif kind is GreaterThan:
            self._within(value + 1, None)
        elif kind is GreaterThanOrEqual:
            self._within(value, None)

    def _within(self, least, most):
        self.least = max(self.least, least)
        if most is not None:
            self.most = most if self.most is None else min(self.most, most)

    def wanted(self, first, stop):
        most = stop - 1 if self.most is None else self.most
        start = min(max(first, self.least), stop)
        return start, max(start, min(stop, most + 1))


def files_of(path: str) -> tuple[list[tuple[str, int]], int]:
    """((file, bytes) in name order, values per record) of a file or folder; only the first header is read."""
    fs, root = _open_fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info]
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(root))
        files = sorted(
            (f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path
        )
    files = [f for f in files if f.size]
    if not files:
        return [], 1
    with fs.open_input_file(files[0].path) as stream:
        width = int(np.frombuffer(stream.read(4), "<i4")[0])
    record = 4 * (width + 1)
    for file in files:
        if width <= 0 or file.size % record:
            raise ValueError(f"{file.path}: size {file.size} is not a multiple of {record}")
    return [(f.path, f.size) for f in files], width


def count_records(path: str) -> int:
    """The number of records of a file or folder, from the sizes of its files; no record is read."""
    files, width = files_of(path)
    return sum(size for _, size in files) // (4 * (width + 1))


@dataclass
class _PartFile(WriterCommitMessage):
    path: str


class _VecsWriter(DataSourceArrowWriter):
    """One part file per Spark partition, kept only if the whole job commits."""

    def __init__(self, path, dtype, column, overwrite):
        self.path, self.dtype, self.column, self.overwrite = path, dtype, column, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        target = f"{root}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        with fs.open_output_stream(target) as stream:
            for batch in iterator:
                lists = batch.column(batch.schema.names.index(self.column))
                if not len(lists):
                    continue
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(self.dtype)
                values = values.reshape(len(lists), -1)
                rows = np.empty((len(lists), values.shape[1] + 1), "<i4")
                rows[:, 0] = values.shape[1]
                rows[:, 1:] = values.view("<i4")
                stream.write(rows.tobytes())
        return _PartFile(target)

    def commit(self, messages):
        fs, root = _open_fs(self.path)
        for number, message in enumerate(sorted(m.path for m in messages if m is not None)):
            fs.move(message, f"{root}/part-{number:06d}")

    def abort(self, messages):
        fs, _ = _open_fs(self.path)
        for message in messages:
            if message is not None:
                fs.delete_file(message.path)


class _VecsSource(DataSource):
    dtype, column, element = "<f4", "features", "float"

    def schema(self):
        return f"id bigint, {self.column} array<{self.element}>"

    def reader(self, schema):
        split = int(self.options.get("splitBytes", _SPLIT_BYTES))
        kind = _FilteringReader if self.options.get("idFilters", "").lower() == "true" else _VecsReader
        return kind(self.options["path"], self.dtype, self.column, split)

    def writer(self, schema, overwrite):
        return _VecsWriter(self.options["path"], self.dtype, self.column, overwrite)


class FvecsSource(_VecsSource):
    @classmethod
    def name(cls):
        return "fvecs"


class IvecsSource(_VecsSource):
    dtype, column, element = "<i4", "neighbors", "int"

    @classmethod
    def name(cls):
        return "ivecs"


def register(spark: SparkSession) -> SparkSession:
    """Make the two formats known to `spark`."""
    ship(spark)
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)
    return spark


def read_fvecs(
    spark: SparkSession, path: str, normalize: bool = False, through: str = "arrow", **options
) -> DataFrame:
    """`id, features`; with `normalize`, every vector divided by its largest absolute value.

    ``through="hadoop"`` reads one file with Hadoop's own file systems instead, for storage that
    the Python workers cannot open.
    """
    rows = _read(spark, path, FvecsSource, through, options)
    return rows.withColumn("features", max_normalize("features")) if normalize else rows


def read_ivecs(
    spark: SparkSession, path: str, normalize: bool = False, through: str = "arrow", **options
) -> DataFrame:
    """`id, neighbors`; with `normalize`, every row divided by its largest absolute value."""
    rows = _read(spark, path, IvecsSource, through, options)
    return rows.withColumn("neighbors", max_normalize("neighbors")) if normalize else rows


def _read(spark, path, source, through, options):
    if through == "hadoop":
        return _read_records(spark, path, source)
    # A source that takes conditions must not meet a session that forbids it, so it is told to.
    if spark.conf.get(_PUSHDOWN, "false") != "true":
        spark.conf.set(_PUSHDOWN, "true")
    options = {"idFilters": "true"} | options
    return register(spark).read.format(source.name()).options(**options).load(path)


def _read_records(spark, path, source):
    """Fixed-length records of one file, numbered in file order."""
    sc = ship(spark).sparkContext
    width = int(np.frombuffer(sc.binaryRecords(path, 4).first(), "<i4")[0])
    records = sc.binaryRecords(path, 4 * (width + 1)).zipWithIndex()
    rows = spark.createDataFrame(records, "record binary, id long")
    dtype, name = source.dtype, path

    @F.arrow_udf(f"array<{source.element}>")
    def decode(record: pa.Array, ids: pa.Array) -> pa.Array:
        raw = np.frombuffer(b"".join(record.to_pylist()), "<i4").reshape(len(record), width + 1)
        _check_lengths(raw[:, 0], width, ids.to_numpy(), name)
        values = np.ascontiguousarray(raw[:, 1:]).view(dtype).reshape(-1)
        return pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * width, pa.array(values))

    return rows.select("id", decode("record", "id").alias(source.column))


def _check_lengths(lengths, width, ids, path):
    wrong = np.flatnonzero(lengths != width)
    if len(wrong):
        at = wrong[0]
        raise ValueError(f"{path}: record {int(ids[at])} has length {int(lengths[at])}, expected {width}")


def write_fvecs(df: DataFrame, path: str, order_by: str = "id", column: str = "features") -> None:
    """Write vectors in the order of `order_by`. A path that holds files already is refused."""
    _write(df, path, order_by, F.col(column).cast("array<float>").alias("features"), "fvecs")


def write_ivecs(df: DataFrame, path: str, order_by: str = "id", column: str = "neighbors") -> None:
    _write(df, path, order_by, F.col(column).cast("array<int>").alias("neighbors"), "ivecs")


def _write(df, path, order_by, values, name):
    register(df.sparkSession)
    fs, root = _open_fs(path)
    if fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{path} holds files already")
    df.orderBy(order_by).select(F.lit(0).cast("long").alias("id"), values).write.format(name).mode("append").save(path)
