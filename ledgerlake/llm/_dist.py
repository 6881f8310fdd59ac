"""Shared plumbing: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _local
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
    return _local


_local: str | None = None


#: When a query that writes a table has ended, its shuffle files go: nothing reads them any more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with name set to value; afterwards it is as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; this cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with setting(df.sparkSession, _CLEAN, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that settle() wrote and that nothing reads any more."""
    path, spark = df._settled_at, df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, root) per node, root the smallest id reachable.

    Alternates the large-star and the small-star step until the edges stay as they are. Each step is an aggregation with
    partial sums and a join that adaptive execution can split, so a node with very many edges is no task of its own.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = settle(now.select(F.col("a").alias("id")).union(now.select("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = settle(near.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        discard(now)
        now = after
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


#: Texts are long, so fewer of them than Spark's default 10,000 go to a Python worker at once.
ROWS_PER_BATCH = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hold Arrow batches to ROWS_PER_BATCH rows for a while, unless the session asks for a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    with setting(spark, name, str(ROWS_PER_BATCH) if before == "10000" else before):
        yield


def shorter(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """batches, cut into ones of at most rows rows."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def give_back() -> None:
    """Give memory that this Python worker no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work):
    """work, a function of batches, after which memory is given back."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        give_back()

    return run
