"""Session helpers: shipping the package to the workers, the shared folder, small tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is treated as model-sized (collected, sent to every task) up to this many rows.
MODEL_ROWS = 100_000
# And up to this size in Arrow.
MODEL_BYTES = 256 << 20
# Search results (a few numbers per row) may be sent to every task up to this many rows.
RESULT_ROWS = 1_000_000

_shipped: set[str] = set()
# Folders that this process has named in the shared folder.
_own: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="vecframe-"), "vecframe_src")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), "vecframe")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A folder given to setCheckpointDir counts as well. Where neither is there, a local session gets a temporary folder and any other master
    is refused, because executors on other machines could not see one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vecframe-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/vecframe/{name}-{uuid.uuid4().hex}"
    _own.append(path)
    return path


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the tables that this process has put into the shared folder; how many there were.

    Results read them lazily, so this comes after the last result was written or collected. An index that
    `build_index` stored without a path is one of them; one that was given a path, or saved, is not.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in _own:
        place = files.Path(path)
        removed += bool(place.getFileSystem(conf).delete(place, True))
    _own.clear()
    return removed


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Store `df` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until `df` has no such column (names compare in lower case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def model_table(df: DataFrame, max_rows: int = MODEL_ROWS) -> DataFrame:
    """`df` computed and marked for broadcast if it has at most `max_rows` rows and `MODEL_BYTES`.

    A larger table comes back unchanged and takes part in ordinary shuffle joins. Of a table with
    arrays a thousand rows come first; only a longer one is computed again, as far as their width allows.
    """
    wide = any("array" in kind or "map" in kind for _, kind in df.dtypes)
    first = min(max_rows, 1000) if wide else max_rows
    head = df.limit(first + 1).toArrow()
    if first < head.num_rows <= max_rows:
        max_rows = min(max_rows, MODEL_BYTES * head.num_rows // head.nbytes)
        head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > MODEL_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))
