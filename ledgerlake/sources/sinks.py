"""Writing releases, stores and traces (SNK). A store is a folder of versions and a pointer, so a rerun changes nothing."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..operators.lineage import cut
from ..operators.maintain import upserted
from ..operators.records import delivery, provenance_rows, source_rows
from ..schemas import AUDIT, BASE_COLUMNS


def export(records: DataFrame, audit: DataFrame, folder: str) -> dict[str, int]:
    """Dataset, provenance, sources, audit and dictionary as CSV; rows written of each, one job a view. (SNK-01, SNK-08, SNK-10, SNK-12)"""
    spark = records.sparkSession
    flat = delivery(records)
    about = spark.createDataFrame([(i, c, "base" if c in BASE_COLUMNS else "derived") for i, c in enumerate(flat.columns)], "place int, column string, kind string")
    views = {"dataset": flat, "provenance": provenance_rows(records), "sources": source_rows(records), "audit": audit.select(*AUDIT.names), "dictionary": about}
    counts = {}
    for name, df in views.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
        counts[name] = seen.get["rows"]  # counted while it was written
    return counts


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_version(rows: DataFrame, folder: str, version: str) -> str:
    """A new version of a store, then the pointer to it. (SNK-02, SNK-09)"""
    rows.write.mode("overwrite").parquet(f"{folder}/{version}")
    _put(rows.sparkSession, f"{folder}/CURRENT", version)
    return f"{folder}/{version}"


def pointer(spark: SparkSession, folder: str) -> str | None:
    """What the store's pointer says, None without one."""
    fs, where = _fs(spark, f"{folder}/CURRENT")
    return spark.read.text(f"{folder}/CURRENT").first()["value"] if fs.exists(where) else None


def put_pointer(spark: SparkSession, folder: str, version: str) -> None:
    _put(spark, f"{folder}/CURRENT", version)


def read_current(spark: SparkSession, folder: str, schema=None) -> DataFrame | None:
    """The version that the pointer names, None without one."""
    fs, where = _fs(spark, f"{folder}/CURRENT")
    if not fs.exists(where):
        return None
    version = spark.read.text(f"{folder}/CURRENT").first()["value"]
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/{version}")


def insert_new(rows: DataFrame, folder: str, key: str, order: str) -> int:
    """Append rows whose key is not there yet, the first of each; how many. (SNK-03, SRC-25)"""
    spark = rows.sparkSession
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*").select(*rows.columns)
    fs, where = _fs(spark, folder)
    if fs.exists(where):
        first = first.join(spark.read.parquet(folder).select(key), key, "left_anti").select(*rows.columns)
    first = cut(first)
    first.write.mode("append").parquet(folder)
    return first.count()


def insert_candidates(rows: DataFrame, folder: str, order: str) -> int:
    """Append candidates whose dedup_key, or where they have none their normalised name, is not there yet; how many. (RES-10, SNK-03)"""
    key = F.coalesce(F.nullif("dedup_key", F.lit("")), norm_name(F.col("name")))
    return insert_new(rows.withColumn("dedup_key", key), folder, "dedup_key", order)


def upsert(batch: DataFrame, folder: str, key: str, order: str, version: str) -> str:
    """The store with the batch's last row of each key, as a new version. (SNK-04)"""
    old = read_current(batch.sparkSession, folder)
    rows = batch if old is None else old
    return write_version(upserted(rows if old is not None else batch.limit(0), batch, key, order), folder, version)


def append(rows: DataFrame, folder: str) -> None:
    """Append audit or decision rows. (SNK-05, SNK-11)"""
    rows.write.mode("append").parquet(folder)


def append_trace(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines. (SNK-06)"""
    events.write.mode("append").json(folder)


def snapshots(contents: DataFrame, folder: str, content: str = "content") -> int:
    """Append contents under their hash, each once. (SNK-07)"""
    return insert_new(contents.withColumn("sha256", F.sha2(content, 256)).withColumn("_o", F.lit(0)), folder, "sha256", "_o")


def manifest(spark: SparkSession, path: str, kind: str, counts: dict[str, int], versions: dict[str, str], started: datetime) -> dict:
    """What a run did, as one JSON document. (SNK-08)"""
    run = {"kind": kind, "run_id": f"{kind}-{started:%Y%m%dT%H%M%SZ}", "started_at": started.isoformat(), "finished_at": datetime.now(timezone.utc).isoformat(), "counts": counts, "versions": versions}
    _put(spark, path, json.dumps(run, indent=2, sort_keys=True))
    return run


def export_pool(candidates: DataFrame, path: str, key: str = "dedup_key") -> None:
    """The pool in the order of its key, as JSON lines. (SNK-13)"""
    candidates.orderBy(key).write.mode("overwrite").json(path)
