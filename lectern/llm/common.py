"""Shared plumbing: table reads, cutting lineage through the shared folder, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may have none; then a temporary folder is set. On a cluster that is an error.
    """
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not told:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: tables between steps need a folder that all executors share")
        told = tempfile.mkdtemp(prefix="lectern-")
        context.setCheckpointDir(told)
    return told.rstrip("/")


#: Folders made by this driver that are still there, by the session that made them.
_made: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def sweep(but: set[str] = frozenset()) -> None:
    """Delete what steps have left in the shared folder, but for the paths given. Results that read them end with it."""
    for path, spark in [x for x in _made.items() if x[0] not in but]:
        remove(spark, path)


@contextlib.contextmanager
def swept():
    """Tables written within are deleted at its end, but for the paths put into the set that it gives."""
    before, kept = set(_made), set()
    try:
        yield kept
    finally:
        sweep(before | kept)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone before
        sweep()


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive executors.

    Returns the reread table and its path, for :func:`remove` once nothing reads it any more; what is
    left goes when the driver ends, or at :func:`sweep`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A table of the driver's own rows. By way of Arrow, as rows of Python objects would start workers on every executor."""
    made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(made, names=list(columns)))


def other(key: str) -> Column:
    """A long key under another expression, for a join of rows with what was grouped by that key.

    Joined by the key itself the rows would stay where grouping put them, all rows of a hot key in one task.
    By another expression both sides are dealt anew, and Spark can split the rows of a large part.
    """
    return F.bitwise_not(F.col(key))


def released(run):
    """``run`` of a task's batches, after which the worker, which waits for other tasks, gives back what it holds no more."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 1 << 22):
    """A batch in parts whose texts have about ``most`` bytes, a row at least, so that what a worker makes of them at once is bounded."""
    if batch.num_rows:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``node, component`` (its smallest node).

    Alternating large-star and small-star rounds; each round is two joins on the node, with the
    minimum pre-aggregated before its shuffle, and ends in a written table. The number of rounds is
    logarithmic. A hub's edges can be split over tasks (:func:`other`). Rows with a null end and self
    links are ignored; isolated nodes have no row.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    e, path = cut(e, "edges")

    def state(x: DataFrame):
        return tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = state(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(other("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").withColumn("k", other("u")).join(low, "k").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, mid = cut(large, "large")
        low, lows = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, done = cut(small.union(low).distinct(), "small")
        for old in (mid, lows, path):
            remove(spark, old)
        now, e, path = state(after), after, done
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
