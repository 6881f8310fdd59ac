"""A store cut into buckets by key: a batch rewrites the buckets that it touches, a lookup opens one. (SNK-04, SRC-09)

A version is a manifest, which names the folder of each bucket; the pointer names the version. Buckets that a batch does not
touch keep their files, and readers of an older version keep theirs, as nothing is written over.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stored
from ..operators.relations import best_per_key
from .sinks import _put, pointer, put_pointer


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the current version is made of: key, buckets, schema and the folder of each bucket that has rows; None without a version."""
    version = pointer(spark, folder)
    return None if version is None else json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version}.json").collect()))


def _rows(spark: SparkSession, folder: str, about: dict, places: list[str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], about["schema"])
    return spark.read.schema(about["schema"]).parquet(*[f"{folder}/{p}" for p in places])


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of the current version, None without one."""
    about = manifest(spark, folder)
    return None if about is None else _rows(spark, folder, about, list(about["places"].values()))


def by_key(spark: SparkSession, folder: str, value) -> DataFrame:
    """The row of a key: one bucket is opened, and of it what its Bloom filters and the order of its keys leave. (SRC-09)"""
    about = manifest(spark, folder)
    b = spark.range(1).select(_bucket(F.lit(value), about["buckets"])).first()[0]
    place = about["places"].get(str(b))
    return _rows(spark, folder, about, [place] if place else []).where(F.col(about["key"]) == F.lit(value))


def upsert(batch: DataFrame, folder: str, key: str, order: str, version: str, buckets: int = 64) -> list[int]:
    """Add a batch, of each key the row that is last in order, as a new version; which buckets were written. (SNK-04)

    The store has as many buckets as its first batch said. Only the touched ones are read and written; a version that is
    there already changes nothing, and one that broke off has no pointer and is done again. Rows without a key are left
    out; order is not kept; a batch has the store's columns.
    """
    spark = batch.sparkSession
    about = manifest(spark, folder)
    if about is None:
        fields = batch.drop(order).schema
        about = {"key": key, "buckets": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "places": {}, "versions": []}
    if version in about["versions"]:
        return []
    columns = [c for c in batch.columns if c != order]
    last = best_per_key(batch.where(F.col(key).isNotNull()), [key], [F.col(order)]).select(*columns)
    new = stored(last.withColumn("_b", _bucket(F.col(key), about["buckets"])))
    touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # as many as there are buckets
    old = _rows(spark, folder, about, [about["places"][str(b)] for b in touched if str(b) in about["places"]])
    kept = old.join(new.select(key), key, "left_anti").select(*columns).withColumn("_b", _bucket(F.col(key), about["buckets"]))
    rows = kept.unionByName(new).repartition("_b").sortWithinPartitions("_b", key)
    rows.write.mode("overwrite").partitionBy("_b").option("parquet.bloom.filter.enabled#" + key, "true").parquet(f"{folder}/data/{version}")
    about["places"] |= {str(b): f"data/{version}/_b={b}" for b in touched}
    about["versions"].append(version)
    _put(spark, f"{folder}/manifests/{version}.json", json.dumps(about, indent=1))
    put_pointer(spark, folder, version)
    return touched
