"""k-nearest-neighbour joins: exact, restricted to probed partitions, and the views on their result.

One operator, `knn_join`, serves them all. It never forms a table of pairs: a numpy kernel scores
blocks inside tasks and only running top-k lists leave a task. It has three physical forms, and
all three give the same rows:

* ``broadcast_base``: the base is small (a sample, centroids; measured, in bytes). Every task
  streams queries and emits final lists, so nothing is shuffled at all.
* ``broadcast_queries``: the query side is small (measured likewise). Every task streams its
  share of the base once, without a shuffle of the base, and emits its top-k per query. Asked for
  by name, the form sends a larger query side in turns, unless a turn holds hardly any queries.
* ``query_groups``: the queries fit into a moderate number of groups of broadcast size. Each group
  is sent to the base in turn, which is read in place, never shuffled or copied; under pruning a
  group holds queries of the same partitions, and its pass reads those partitions only. Asked for
  by name, the form takes larger groups rather than more of them, as far as a task can hold them.
* ``blocks``: neither side is small. Rows are counted per partition, a partition is cut into as
  many base blocks and query blocks as its size and its share of the work ask for (a partition that
  holds a third of all rows simply gets more blocks), and each pair of blocks is one shuffle group.
  A row is copied once per block of the other side, so the number of blocks follows the cores, not
  the rows, until a task could not hold its queries. Pairs are numbered and dealt to tasks by their
  work. Queries of a group are held in memory, its base rows stream past them in sorted order and
  may spill.

Lists of tasks meet in a shuffle. Without more, k rows per query and task would travel, however
many tasks read the base. A search of the whole base therefore bounds every query's k-th distance
first, by its k-th nearest row in a sample of one base row in `Limits.bound_share` (whose own
search is bounded by a sample of the sample): tasks then emit rows within the bound only, about
`k * bound_share` per query in all. Lists without a bound are merged in two stages, by query and
group of tasks first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.operators.kernel import DECIMALS, TopK, groups, list_matrix, rounded
from vecframe.session import RESULT_ROWS, fresh_path, model_table, ship, write_and_read

STRATEGIES = ("auto", "broadcast_queries", "broadcast_base", "query_groups", "blocks")
# Partitions that a condition on the base may name one by one.
_NAMED_PARTS = 50_000
# Groups of tasks whose lists are merged before the lists of a query meet.
_MERGE_GROUPS = 16
# Pairs of blocks that the work is cut into at least, and for each core.
_PAIRS, _PAIRS_PER_CORE = 64, 4
# Rows of lists that are handed to Spark at once.
_EMIT_ROWS = 100_000
# Queries that a broadcast holds at least: fewer are not worth a read of the base.
_LEAST_SENT = 16
# Passes over the base that run in one job.
_PASSES = 16
# Compared pairs of rows, and shuffled rows, from which on a task of their own pays.
_TASK_WORK, _TASK_ROWS = 10**9, 50_000
# Bytes of queries and their lists that a task holds at once.
_HELD_BYTES = 96 << 20


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the choice of a physical form."""

    broadcast_bytes: int = 32 << 20  # Arrow size up to which one side is sent to every task
    base_block_rows: int = 500_000  # base rows streamed per shuffle group, at least where a side has so many
    query_block_rows: int = 16_384  # query rows held in memory per shuffle group, likewise
    max_shuffle_partitions: int = 100_000
    query_groups: int = 64  # groups of queries, of broadcast size or larger, that are sent to the base in turn
    bound_share: int = 64  # one base row in so many bounds the k-th distances
    bound_rows: int = 2_000_000  # base rows from which on that is done: fewer are read by few tasks


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    probes: str | None = None,
    part: str = "part",
    bound: str | None = None,
    exclude_self: bool = False,
    per_part: bool = False,
    carry: str | None = None,
    clustered: bool = False,
    strategy: str = "auto",
    limits: Limits = Limits(),
    query_id: str = "qid",
    base_id: str = "id",
    features: str = "features",
) -> DataFrame:
    """The `k` nearest base rows of every query: `qid, neighbor, distance, rank`.

    `probes` names a query column with the list of `part` values to search; without it the whole
    base is searched. `bound` names a query column with a distance that the k-th neighbour is
    known not to exceed. `per_part` keeps k rows per (query, partition) and adds `part`. `carry`
    names an integer column of the base that comes along as `tag`. `clustered` says that the base
    is stored with the rows of a partition together.
    Both sides may be read more than once, so a side that is costly to compute should be stored.
    Rows are ordered by (distance to nine decimals, id). Rows without a distance (NULL vector,
    zero vector under cosine) are never neighbours.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if per_part and probes is None:
        raise ValueError("per_part needs probes")
    ship(queries.sparkSession)
    q = [F.col(query_id).cast("long").alias("qid"), F.col(features).alias("vec")]
    b = [F.col(base_id).cast("long").alias("id"), F.col(features).alias("vec")]
    if probes is not None:
        q.append(F.array_distinct(F.col(probes).cast("array<long>")).alias("parts"))
        b.append(F.col(part).cast("long").alias("part"))
    if carry is not None:
        b.append(F.col(carry).cast("long").alias("tag"))
    if bound is not None:
        q.append(F.coalesce(F.col(bound).cast("double"), F.lit(float("inf"))).alias("bound"))
    q = queries.select(*q).where("vec is not null" + (" and parts is not null" if probes else ""))
    b = base.select(*b).where("vec is not null" + (" and part is not null" if probes else ""))
    job = _Job(k, metric, exclude_self, per_part, probes is not None, carry is not None, clustered)

    return _run(job, q, b, strategy, limits)


def _run(job: _Job, q: DataFrame, b: DataFrame, strategy: str, limits: Limits, level: int = 0) -> DataFrame:
    """The join in one of its forms; `level` counts the samples of samples that bound distances."""
    if strategy == "broadcast_base":
        return _broadcast_base(job, q, _required(_bounded(b, "id", limits.broadcast_bytes)))
    if strategy == "blocks":
        return _blocks(job, _with_bound(job, q, b, limits, level), b, limits)
    if strategy == "query_groups":
        size = _bytes(q, "qid", None)
        return _query_groups(job, _with_bound(job, q, b, limits, level), b, size, limits)
    few_queries = _bounded(q, "qid", limits.broadcast_bytes)
    if strategy == "broadcast_queries":
        if few_queries is None:
            size = _in_turn(q, limits)
            return _query_groups(job, _with_bound(job, q, b, limits, level), b, size, limits)
        return _broadcast_queries(job, _with_bound(job, q, b, limits, level, few_queries), b)
    if level == 0 and few_queries is not None and few_queries.num_rows < 100:
        return _broadcast_queries(job, _with_bound(job, q, b, limits, level, few_queries), b)
    few_rows = _bounded(b, "id", limits.broadcast_bytes)
    if few_rows is not None:
        if few_queries is not None:  # already here: spread it over all tasks
            q = q.sparkSession.createDataFrame(few_queries, q.schema)
        return _broadcast_base(job, q, few_rows)
    if few_queries is not None:
        return _broadcast_queries(job, _with_bound(job, q, b, limits, level, few_queries), b)
    size = _bytes(q, "qid", limits.query_groups * limits.broadcast_bytes)
    q = _with_bound(job, q, b, limits, level)
    if size is not None:
        return _query_groups(job, q, b, size, limits)
    return _blocks(job, q, b, limits)


@dataclass(frozen=True)
class _Job:
    k: int
    metric: str
    exclude_self: bool
    per_part: bool
    pruned: bool
    tagged: bool
    clustered: bool

    @property
    def keys(self) -> list[str]:
        return ["qid", "part"] if self.per_part else ["qid"]

    @property
    def schema(self) -> str:
        part = "part long, " if self.per_part else ""
        tag = "tag long, " if self.tagged else ""
        return f"qid long, {part}neighbor long, {tag}distance double, rank int"

    @property
    def partial_schema(self) -> str:
        """`key` is the distance as it is ranked."""
        return self.schema.replace("rank int", "key double")

    def open(self, queries):
        """Empty lists for a batch of queries, and which of them search which partition."""
        ids, vectors = _numpy(queries.column("qid")), list_matrix(queries.column("vec"))
        bound = _numpy(queries.column("bound")) if "bound" in queries.schema.names else None
        if not self.pruned:
            return TopK(ids, vectors, self.k, self.metric, self.exclude_self, bound), None, None
        probes = queries.column("parts")
        length = _numpy(pc.list_value_length(probes))
        member, part = np.repeat(np.arange(len(ids)), length), _numpy(pc.list_flatten(probes))
        if not self.per_part:
            lists = TopK(ids, vectors, self.k, self.metric, self.exclude_self, bound)
            return lists, {p: member[rows] for p, rows in groups(part)}, None
        bound = None if bound is None else bound[member]
        lists = TopK(ids[member], vectors, self.k, self.metric, self.exclude_self, bound, member)
        return lists, dict(groups(part)), part

    def offer(self, lists, searchers, base):
        """Show a batch of base rows to the queries that search their partition."""
        if base.num_rows == 0:
            return
        ids, vectors, tags = _numpy(base.column("id")), list_matrix(base.column("vec")), self.tags(base)
        if searchers is None:
            lists.update(None, ids, vectors, tags)
            return
        for key, rows in groups(_numpy(base.column("part"))):
            if key in searchers:
                own = None if tags is None else tags[rows]
                lists.update(searchers[key], ids[rows], vectors[rows], own)

    def held_bytes(self, queries: pa.Table) -> int:
        """About how many bytes a task needs to hold these queries: vectors, prepared vectors, lists."""
        lists = queries.num_rows
        if self.per_part and "parts" in queries.schema.names:
            lists = pc.sum(pc.list_value_length(queries.column("parts"))).as_py() or 0
        return 2 * queries.nbytes + lists * (24 * self.k + 32)

    def tags(self, base):
        return _numpy(base.column("tag")) if self.tagged else None

    def emit(self, lists, part=None, final=False):
        """Batches of the lists, with so few rows that their columns are small beside the lists themselves."""
        part = np.broadcast_to(part, len(lists.query_ids)) if self.per_part else None
        step = max(1, _EMIT_ROWS // self.k)
        for start in range(0, len(lists.query_ids), step):
            row, neighbor, distance, rank, tag = lists.result(start, start + step)
            columns = {"qid": pa.array(lists.query_ids[row], pa.int64())}
            if self.per_part:
                columns["part"] = pa.array(part[row], pa.int64())
            columns["neighbor"] = pa.array(neighbor, pa.int64())
            if self.tagged:
                columns["tag"] = pa.array(tag, pa.int64())
            columns["distance"] = pa.array(distance, pa.float64())
            if final:
                columns["rank"] = pa.array(rank, pa.int32())
            else:
                columns["key"] = pa.array(rounded(distance), pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    def merge(self, partial: DataFrame, bounded: bool) -> DataFrame:
        """Final lists from per-task lists. A task's lists hold k rows per query at most, so ranking
        them before the shuffle would sort them for nothing. Without a bound on distances a query
        may have lists in many tasks; those of a group of tasks are merged first."""
        if not bounded:
            tasks = partial.withColumn("_tasks", F.spark_partition_id() % _MERGE_GROUPS)
            partial = self._top(tasks.repartition("qid", "_tasks"), [*self.keys, "_tasks"]).drop("_tasks", "rank")
        return self._top(partial.repartition("qid"), self.keys).drop("key")

    def shortened(self, partial: DataFrame) -> DataFrame:
        """Per-task lists, merged to one per query that can be merged further."""
        return self._top(partial.repartition("qid"), self.keys).drop("rank")

    def _top(self, lists: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("key", "neighbor")
        return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)


def _numpy(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return column.to_numpy()
    return column.to_numpy(zero_copy_only=False)


def ranked_distance(distance="distance"):
    """Distances are ranked to nine decimals, so that forms differing in the last bits agree."""
    return F.round(distance, DECIMALS)


def topk_per_query(
    candidates: DataFrame, k: int, keys: list[str] | None = None, neighbor: str = "neighbor"
) -> DataFrame:
    """The k candidates of smallest (distance, id) per query, with their rank from 1.

    Spark limits every map task to k rows per query before the shuffle (WindowGroupLimit).
    """
    order = Window.partitionBy(*(keys or ["qid"])).orderBy(ranked_distance(), neighbor)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounded(df: DataFrame, key: str, max_bytes: int) -> pa.Table | None:
    """All rows of `df` if they fit in `max_bytes`, else None.

    A large table costs two short jobs: its first rows tell the width of a row, and a limited
    count of its keys, without vectors, tells that there are too many.
    """
    first = 2000
    head = df.limit(first + 1).toArrow()
    if head.num_rows <= first:
        return head if head.nbytes <= max_bytes else None
    rows = int(max_bytes / (head.nbytes / head.num_rows))
    if rows <= first or not _at_most(df, key, rows):
        return None
    table = df.toArrow()
    return table if table.nbytes <= 2 * max_bytes else None  # later rows may have longer lists


def _at_most(df: DataFrame, key: str, rows: int) -> bool:
    """Whether `df` has at most so many rows, without reading more of it, or other columns, than needed."""
    return df.select(key).limit(rows + 1).count() <= rows


def _bytes(df: DataFrame, key: str, most: int | None) -> int | None:
    """About how many bytes `df` takes in Arrow; None if more than `most`."""
    head = df.limit(1000).toArrow()
    width = head.nbytes / max(1, head.num_rows)
    if most is not None and not _at_most(df, key, int(most / max(1, width))):
        return None
    return math.ceil(df.count() * width)


def _only_parts(base: DataFrame, wanted: list[int]) -> DataFrame:
    """Base rows of the given partitions; the condition reaches the scan as a folder or row-group filter."""
    if len(wanted) > _NAMED_PARTS:
        return base
    # One text, as naming thousands of values one by one takes seconds.
    return base.where(f"part IN ({','.join(str(int(p)) for p in wanted)})" if wanted else "false")


def _with_bound(job: _Job, queries: DataFrame, base: DataFrame, limits: Limits, level: int, table: pa.Table | None = None):
    """The queries (or the same as a `table`) with a bound on their k-th distance, where one is worth its price.

    Any base rows bound the distances, so a query's k-th nearest row in a sample does: no row of
    its list is farther. The sample is chosen by a hash of the id and stored.
    """
    given = queries if table is None else table
    names = queries.columns if table is None else table.schema.names
    if job.pruned or "bound" in names or _at_most(base, "id", limits.bound_rows):
        return given
    share = limits.bound_share ** (level + 1)
    sample = write_and_read(base.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("id", "vec"), "bound-sample")
    inner = replace(job, tagged=False, clustered=False)
    found = _run(inner, queries.select("qid", "vec"), sample, "auto", limits, level + 1)
    bounds = found.where(F.col("rank") == job.k).select("qid", F.col("distance").alias("bound"))
    if table is None:
        infinite = F.coalesce("bound", F.lit(float("inf")))
        # Every pass or block reads the queries again, so the bounds are not left to be found again.
        return write_and_read(queries.join(bounds, "qid", "left").withColumn("bound", infinite), "bounded")
    rows = bounds.toArrow().sort_by("qid")  # a row for each query of the table at most
    known, value = _numpy(rows.column("qid")), _numpy(rows.column("bound"))
    ids = _numpy(table.column("qid"))
    at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
    bound = np.where(known[at] == ids, value[at], np.inf) if len(known) else np.full(len(ids), np.inf)
    return table.append_column("bound", pa.array(bound))


def _required(table: pa.Table | None) -> pa.Table:
    if table is None:
        raise ValueError("the side to broadcast is larger than limits.broadcast_bytes")
    return table


def _in_turn(queries: DataFrame, limits: Limits) -> int:
    """About how many bytes these queries take, which are too many to be sent at once."""
    size, rows = _bytes(queries, "qid", None), queries.count()
    if rows * limits.broadcast_bytes < _LEAST_SENT * size:
        raise ValueError(f"{_LEAST_SENT} rows of the side to broadcast are larger than limits.broadcast_bytes")
    return size


def _broadcast_queries(job: _Job, queries: pa.Table, base: DataFrame) -> DataFrame:
    passes = (_in_place(job, portion, base) for portion in _portions(job, queries, max(1, queries.nbytes)))
    return _merged(job, passes, "bound" in queries.schema.names, base.sparkSession)


def _in_place(job: _Job, queries: pa.Table, base: DataFrame) -> DataFrame:
    """Per-task lists of some queries, from a base that is read where it lies."""
    spark = base.sparkSession
    if job.pruned:
        wanted = pc.unique(pc.list_flatten(queries.column("parts"))).drop_null().to_pylist()
        base = _only_parts(base, wanted)
        if len(wanted) > 64 and not job.clustered:  # few rows of a partition per batch otherwise
            base = base.sortWithinPartitions("part")
    shared = spark.sparkContext.broadcast(queries)

    def search(batches):
        lists, searchers, part = job.open(shared.value)
        for batch in batches:
            job.offer(lists, searchers, batch)
        yield from job.emit(lists, part)

    return base.mapInArrow(search, job.partial_schema)


def _query_groups(job: _Job, queries: DataFrame, base: DataFrame, size: int, limits: Limits) -> DataFrame:
    """The queries, about `size` bytes, in groups of broadcast size, each sent to the base in turn.

    A pass costs a read of the base, so beyond `limits.query_groups` groups they grow instead, up to what a task can
    hold. Under pruning, queries that begin with the same partition come together, so that a pass reads few
    partitions; a partition that many queries begin with fills several groups.
    """
    groups = min(math.ceil(size / limits.broadcast_bytes), limits.query_groups)
    groups = max(1, groups, math.ceil(size * _held_share(job, queries) / _HELD_BYTES))
    near = [F.get("parts", F.lit(0))] if job.pruned else []
    placed = queries.repartitionByRange(groups, *near, F.xxhash64("qid")).withColumn("_group", F.spark_partition_id())
    path = fresh_path(queries.sparkSession, "query-groups")
    placed.write.partitionBy("_group").parquet(path)
    stored = queries.sparkSession.read.schema(placed.schema).parquet(path)
    most = max(2 * limits.broadcast_bytes, math.ceil(2 * size / groups))
    passes = (
        _in_place(job, portion, base)
        for group in sorted(r[0] for r in stored.select("_group").distinct().collect())
        for portion in _portions(job, stored.where(F.col("_group") == group).drop("_group").toArrow(), most)
    )
    return _merged(job, passes, "bound" in queries.columns, queries.sparkSession)


def _held_share(job: _Job, queries: DataFrame) -> float:
    """Bytes that a task needs to hold queries, per byte of theirs, judged by the first thousand."""
    head = queries.limit(1000).toArrow()
    return job.held_bytes(head) / max(1, head.nbytes)


def _portions(job: _Job, queries: pa.Table, most: int) -> list[pa.Table]:
    """Queries in slices of `most` bytes, and no more than a task can hold twice over (sizes are estimates)."""
    n = max(1, math.ceil(queries.nbytes / most), math.ceil(job.held_bytes(queries) / (2 * _HELD_BYTES)))
    step = max(1, math.ceil(queries.num_rows / n))
    return [queries.slice(i, step) for i in range(0, queries.num_rows, step)]


def _merged(job: _Job, passes, bounded: bool, spark) -> DataFrame:
    """Final lists of several passes over the base. Of more than `_PASSES` so many run at a time, and their lists are
    stored: in one stage, every task would report on the operators of all passes, whose number grows likewise."""
    partial, stored = [], []
    for one in passes:
        if len(partial) == _PASSES:
            stored.append(write_and_read(job.shortened(reduce(DataFrame.unionByName, partial)), "lists"))
            partial = []
        partial.append(one)
    if not partial:
        return spark.createDataFrame([], job.schema)
    if stored:
        stored.append(write_and_read(job.shortened(reduce(DataFrame.unionByName, partial)), "lists"))
    # Stored lists hold k rows per query, so they meet at once.
    return job.merge(reduce(DataFrame.unionByName, stored or partial), bounded or bool(stored))


def _broadcast_base(job: _Job, queries: DataFrame, base: pa.Table) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(base)

    def search(batches):
        rows = shared.value.to_batches()
        for batch in batches:
            lists, searchers, part = job.open(batch)
            for chunk in rows:
                job.offer(lists, searchers, chunk)
            yield from job.emit(lists, part, final=True)

    return queries.mapInArrow(search, job.schema)


def _rows_held(job: _Job, queries: DataFrame) -> int:
    """How many of these queries a task can hold, judged by the first thousand."""
    head = queries.limit(1000).toArrow()
    return _HELD_BYTES * head.num_rows // max(1, job.held_bytes(head)) or 1


def _pairs(spark) -> int:
    return max(_PAIRS, _PAIRS_PER_CORE * spark.sparkContext.defaultParallelism)


def _layout(sizes: DataFrame, limits: Limits, rows_held: int) -> DataFrame:
    """`part, n_base, n_query, base_blocks, query_blocks` for a table of the first three.

    A row of one side is copied for every block of the other. With blocks of fixed size copies would grow with the
    square of the rows; therefore a partition is cut as its share of the work asks for, about `_pairs` pairs in all,
    into blocks that may be larger than the limits say. Only blocks of more queries than a task holds are cut further.
    """
    work = F.col("n_base").cast("double") * F.col("n_query")
    total = sizes.agg(F.sum(work)).first()[0] or 1.0
    cuts = F.ceil(F.sqrt(work * (_pairs(sizes.sparkSession) / total)))
    held = max(rows_held, limits.query_block_rows)
    return model_table(sizes.select(
        "part", "n_base", "n_query",
        F.least(F.ceil(F.col("n_base") / limits.base_block_rows), cuts).cast("int").alias("base_blocks"),
        F.greatest(
            F.least(F.ceil(F.col("n_query") / limits.query_block_rows), cuts), F.ceil(F.col("n_query") / held)
        ).cast("int").alias("query_blocks"),
    ))


def _block_tasks(layout: DataFrame, limits: Limits) -> int:
    """Shuffle partitions for the block pairs: about one full pair of blocks, and no more shuffled
    rows than a base block, per task. Small pairs share tasks; blocks of a few rows do not ask for
    more tasks than the cores and the work can use."""
    n_base, n_query, s, t = (
        F.col(c).cast("double") for c in ("n_base", "n_query", "base_blocks", "query_blocks")
    )
    total = layout.agg(
        F.sum(s * t).alias("pairs"),
        F.sum(n_base * n_query).alias("work"),
        F.sum(n_base * t + n_query * s).alias("rows"),
    ).first()
    if total["pairs"] is None:
        return 1
    tasks = max(
        total["work"] / (limits.base_block_rows * limits.query_block_rows),
        total["rows"] / limits.base_block_rows,
        layout.sparkSession.sparkContext.defaultParallelism,
    )
    most = max(total["work"] / _TASK_WORK, total["rows"] / _TASK_ROWS, _pairs(layout.sparkSession))
    return int(min(math.ceil(tasks), math.ceil(most), total["pairs"], limits.max_shuffle_partitions))


def _dealt(layout: DataFrame, n_tasks: int, limits: Limits) -> DataFrame:
    """`layout` with the place of a partition's pairs on the line of tasks, each as long as its work."""
    pairs = F.col("base_blocks").cast("double") * F.col("query_blocks")
    rows = F.col("n_base") / F.col("base_blocks") + F.col("n_query") / F.col("query_blocks")
    work = F.col("n_base").cast("double") * F.col("n_query") / (pairs * limits.query_block_rows)
    weighed = layout.withColumn("pair_work", rows + work)
    # One row per partition, so this unpartitioned window sees metadata only.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = weighed.agg(F.sum(pairs * F.col("pair_work")).alias("total")).first()["total"] or 1.0
    scale = F.lit(n_tasks / total)
    placed = weighed.withColumn("first_task", F.coalesce(F.sum(pairs * F.col("pair_work")).over(before), F.lit(0.0)) * scale)
    return model_table(placed.select(
        "part", "base_blocks", "query_blocks", "first_task", (F.col("pair_work") * scale).alias("pair_tasks")
    ))


def _blocks(job: _Job, queries: DataFrame, base: DataFrame, limits: Limits) -> DataFrame:
    bounded = "bound" in queries.columns
    if job.pruned:
        queries = queries.withColumn("part", F.explode("parts")).drop("parts")
    else:
        queries = queries.withColumn("part", F.lit(0).cast("long"))
        base = base.withColumn("part", F.lit(0).cast("long"))
    if "bound" not in queries.columns:
        queries = queries.withColumn("bound", F.lit(float("inf")))
    if not job.tagged:
        base = base.withColumn("tag", F.lit(0).cast("long"))

    # How many blocks each partition is cut into: counts only, no vectors are read for it.
    n_base = base.groupBy("part").agg(F.count("*").alias("n_base"))
    n_query = queries.groupBy("part").agg(F.count("*").alias("n_query"))
    layout = _layout(model_table(n_base.join(n_query, "part")), limits, _rows_held(job, queries))
    n_tasks = _block_tasks(layout, limits)
    if job.pruned:
        base = _only_parts(base, [r["part"] for r in layout.select("part").limit(_NAMED_PARTS + 1).collect()])
    layout = _dealt(layout, n_tasks, limits)

    def blocks(column):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    pair = F.col("base_block") * F.col("query_blocks") + F.col("query_block")
    task = F.least(F.floor(F.col("first_task") + pair * F.col("pair_tasks")), F.lit(n_tasks - 1)).cast("int").alias("task")
    key = ["part", "base_block", "query_block"]
    base_side = (
        base.join(layout, "part")
        .withColumn("base_block", F.pmod(F.xxhash64("id"), F.col("base_blocks")).cast("int"))
        .withColumn("query_block", blocks("query_blocks"))
        .select(task, *key, F.lit(1).alias("side"), "id", "vec", "tag", F.lit(0.0).alias("bound"))
    )
    query_side = (
        queries.join(layout, "part")
        .withColumn("query_block", F.pmod(F.xxhash64("qid"), F.col("query_blocks")).cast("int"))
        .withColumn("base_block", blocks("base_blocks"))
        .select(task, *key, F.lit(0).alias("side"), F.col("qid").alias("id"), "vec",
                F.lit(0).cast("long").alias("tag"), "bound")
    )
    placed = (
        query_side.unionByName(base_side)
        .repartitionById(n_tasks, "task")
        .sortWithinPartitions(*key, "side")
    )

    def search(batches):
        current, held, lists = None, [], None
        for batch in batches:
            marks = np.stack([_numpy(batch.column(c)) for c in [*key, "side"]])
            change = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
                if start == stop:
                    continue
                run = batch.slice(start, stop - start)
                group, side = tuple(marks[:3, start]), marks[3, start]
                if group != current:
                    if lists is not None:
                        yield from job.emit(lists, current[0])
                    current, held, lists = group, [], None
                if side == 0:
                    held.append(run)
                    continue
                if lists is None and held:
                    table = pa.Table.from_batches(held)
                    lists = TopK(_numpy(table.column("id")), list_matrix(table.column("vec")), job.k,
                                 job.metric, job.exclude_self, _numpy(table.column("bound")))
                    held = table = []
                if lists is not None:
                    lists.update(None, _numpy(run.column("id")), list_matrix(run.column("vec")),
                                 job.tags(run))
        if lists is not None:
            yield from job.emit(lists, current[0])

    return job.merge(placed.mapInArrow(search, job.partial_schema), bounded)


def as_predictions(neighbors: DataFrame, queries: DataFrame | None = None, query_id: str = "qid") -> DataFrame:
    """One row per query: `qid, prediction array<struct<neighbor, distance>>`, nearest first.

    With `queries` given, queries that found nothing get an empty list.
    """
    hit = F.struct("rank", "neighbor", "distance")
    nested = neighbors.groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("hits")).select(
        "qid",
        F.transform("hits", lambda h: F.struct(
            h["neighbor"].alias("neighbor"), h["distance"].alias("distance"))).alias("prediction"),
    )
    if queries is None:
        return nested
    ids = queries.select(F.col(query_id).cast("long").alias("qid"))
    empty = F.from_json(F.lit("[]"), nested.schema["prediction"].dataType)
    return ids.join(nested, "qid", "left").withColumn("prediction", F.coalesce("prediction", empty))


def ordered_result(predictions: DataFrame) -> DataFrame:
    """The result in query-id order, where the order is part of the contract."""
    return predictions.orderBy("qid")


def neighbor_ids(predictions: DataFrame) -> DataFrame:
    """`qid, neighbors`: only the neighbour ids of every prediction list."""
    return predictions.select("qid", F.col("prediction.neighbor").alias("neighbors"))


def lookup_labels(
    neighbors: DataFrame, labels: DataFrame, label: str, base_id: str = "id"
) -> DataFrame:
    """`qid, labels`: the label of each neighbour, nearest first, by an equi-join on the id.

    A result of moderate size is sent to the labels, which are as many as the base rows.
    """
    found = model_table(neighbors.select("qid", "neighbor", "rank"), RESULT_ROWS).join(
        labels.select(F.col(base_id).cast("long").alias("neighbor"), F.col(label).alias("label")),
        "neighbor",
    )
    pair = F.struct("rank", "label")
    return found.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["label"]).alias("labels")
    )
