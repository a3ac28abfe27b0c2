"""What the operators share on the Spark side: staged tables, grouped Arrow maps, distributed connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a Python worker gets at once.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get BATCH rows at once at most: its default of 10,000 long texts fills them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker's next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back after each batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                give_back()

        yield from run(each())
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or one set here for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="gramlake-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors, gives plans real sizes."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # for release()
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


class Scope:
    """Owns the tables staged inside: on leaving, all but the kept are deleted, and these become the outer scope's.

        with Scope() as own:
            ...
            return own.keep(result, the staged tables that result still reads)
    """

    def __enter__(self) -> Scope:
        self.kept: list[DataFrame] = []
        _SCOPES.append([])
        return self

    def keep(self, result: DataFrame, *tables: DataFrame) -> DataFrame:
        self.kept += tables
        return result

    def __exit__(self, kind: type | None, *_: object) -> None:
        staged = _SCOPES.pop()
        paths = {t._staged_at for t in self.kept}
        for t in staged:
            if t._staged_at not in paths:
                release(t)
            elif _SCOPES:
                _SCOPES[-1].append(t)


_EARLIER: list[DataFrame] = []


def between_stages(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline's stage, whose result is written before the next begins: what one stage still held goes when the next starts."""

    @functools.wraps(step)
    def run(*args: object) -> DataFrame:
        for t in _EARLIER:
            release(t)
        _EARLIER.clear()
        _SCOPES.append([])
        try:
            return step(*args)
        finally:
            _EARLIER.extend(_SCOPES.pop())

    return run


def release(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads. One that is gone already is passed over."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in which those rows follow each other. Keys are integers, not null."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in ks], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = tuple(k[lo] for k in ks)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(lo, hi - lo))
            last = key
    if parts:
        yield pa.Table.from_batches(parts)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, parts: int | None = None) -> DataFrame:
    """fn on the rows of each key, streamed from sorted partitions: many small groups share one Python call. With parts, the
    only key is a number below parts, and each is a partition of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            if (out := fn(table)) is not None:
                yield from out.to_batches()

    dealt = df.repartitionById(parts, F.col(keys[0])) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


#: A key with over one in HOT of the rows is joined by broadcast: there are fewer than HOT such keys, of a few numbers each.
HOT = 1024


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes that Spark's statistics give df, or None where it does not know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """left joined to right (inner) on keys that are unique in right and the first of which is a long, wherever one key may
    have a third of left's rows: right's column count has the number of left's rows. Keys with over one in HOT of total
    rows meet theirs by broadcast, and then have a key of their own in the shuffled join of the others."""
    values = [c for c in right.columns if c not in keys and c != count]
    hot = right.where(F.col(count) > total // HOT).select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(v).alias(f"hot_{v}") for v in values])
    same = [F.col(k) == F.col(f"hot_{k}") for k in keys]
    out = left.join(F.broadcast(hot), same, "left").withColumn("cold_key", F.when(F.col(f"hot_{keys[0]}").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*left.columns)))
    cold = right.where(F.col(count) <= total // HOT).select(F.col(keys[0]).alias("cold_key"), *[F.col(k).alias(f"cold_{k}") for k in keys[1:]], *[F.col(v).alias(f"cold_{v}") for v in values], F.lit(True).alias("cold_found"))
    on = ["cold_key", *[F.col(k) == F.col(f"cold_{k}") for k in keys[1:]]]
    if len(keys) > 1:
        cold = cold.withColumnRenamed("cold_key", "cold_first")
        on = [F.col("cold_key") == F.col("cold_first"), *on[1:]]
    out = out.join(cold, on, "left")
    is_hot = F.col(f"hot_{keys[0]}").isNotNull()
    out = out.where(is_hot | F.col("cold_found"))
    return out.select(*left.columns, *[F.when(is_hot, F.col(f"hot_{v}")).otherwise(F.col(f"cold_{v}")).alias(v) for v in values])


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of edges (a, b) that is not the smallest of its connected component.

    Alternates large-star and small-star steps, each a min-aggregate and a join on integer ids. A hub's rows pre-aggregate,
    and its join is a broadcast of one row (`spread_join`). Every round is a staged table; nothing is collected.
    """
    size = [F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))]
    now = stage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), label)
    mark = now.agg(*size).first()
    while mark[0]:
        down = now.select(F.col("lo").alias("node"), F.col("lo").alias("m"), F.lit(1).alias("n"))
        least = down.unionByName(now.select(F.col("hi").alias("node"), F.col("lo").alias("m"), F.lit(0).alias("n"))).groupBy("node").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
        large = spread_join(now, least.where("n > 0").withColumnRenamed("node", "lo"), ["lo"], "n", mark[0])
        large = large.select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["hi"], "n", mark[0]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        after = stage(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), label)
        new = after.agg(*size).first()
        release(now)
        now = after
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
