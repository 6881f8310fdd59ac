"""Cutting lineage between rounds of an iterative operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def cut(df: DataFrame) -> DataFrame:
    """df read back from the cluster's checkpoint folder; on a single machine without one, from a new local folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerlake-"))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for files that a query writes and reads again."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/files/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in a scratch folder and read again: one job, and the planner knows its size."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join with at most so many rows is broadcast; it is counted first.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, stored, to be broadcast if it has at most FEW rows; else a table of its own, so that adaptive execution can split what it is joined with."""
    kept = stored(df)
    return broadcast(kept) if kept.count() <= FEW else kept


def sized(kept: DataFrame) -> DataFrame:
    """kept, which is stored, to be broadcast if it has at most FEW rows; else to be grown()."""
    return broadcast(kept) if kept.count() <= FEW else grown(kept)


def grown(df: DataFrame) -> DataFrame:
    """df, which grows with the input, to be sorted and merged with what it is joined with.

    Spark takes a stored table to be as large as its packed files. A few MB of these can be a million rows, which it would
    broadcast, so that the driver builds them whole; once a join is planned so, adaptive execution leaves it.
    """
    return df.hint("merge")


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
