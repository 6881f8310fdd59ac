"""Operator 5: two-pass external shuffle into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._dist import settle

LAW = "key"


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is highest, so one more shard only takes rows into itself."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))).s


def fisher_yates(n: int, seed: int | list[int]) -> np.ndarray:
    """A permutation of range(n); numpy's own is Fisher and Yates's shuffle."""
    return np.random.default_rng(seed).permutation(n)


def external_shuffle(docs: DataFrame, shards: int = 40, bucket_bytes: int = 32 << 20, seed: int = 11, overhead: int = 16) -> DataFrame:
    """docs with size, shard, grown_shard, bucket and slot: a random order within each shard, slots gapless from 0.

    First pass: the bytes of each shard decide into how many memory-sized buckets it is cut, and a seeded hash of doc_id
    and text scatters the rows over them; one count for each bucket gives the slot at which it begins. Second pass: the
    rows meet in their buckets, each is put in a fixed order and Fisher-Yates shuffled, and its slots follow on. No task
    holds more than a bucket (and rows that agree in id and text, which are of one bucket). The shard is decided by doc_id and
    the number of shards alone (law "key"). Null text has no bytes, a null doc_id is a key; an empty table gives no rows;
    other columns stay, those named like an added one are replaced. write_shards() writes the result.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "grown_shard", "bucket", "slot", "_order")
    placed = docs.select("*", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"), shard_of(F.col("doc_id"), shards, seed).alias("shard"))
    cut = settle(placed.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / bucket_bytes)).cast("long").alias("_buckets")))  # as many rows as shards
    parts = 2 * (cut.agg(F.sum("_buckets")).first()[0] or 1)  # so that few tasks have two buckets, however many there are
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text")
    scattered = placed.join(F.broadcast(cut), "shard").withColumn("_order", order).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "_order"), F.col("_buckets"))).drop("_buckets")
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    begins = counts.select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("begin"))
    grown = scattered.withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, seed))
    schema = T.StructType([*grown.schema.fields, T.StructField("slot", T.LongType())])
    names = [f.name for f in schema.fields]

    def shuffle(key: tuple, rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows["_order"].to_numpy(),))]
        rows = rows.iloc[fisher_yates(len(rows), [seed, int(key[0]), int(key[1])])]
        rows["slot"] = np.arange(len(rows), dtype=np.int64) + int(begin["begin"].iloc[0])
        return rows[names]

    dealt = grown.repartition(parts, "shard", "bucket").groupBy("shard", "bucket")
    return dealt.cogroup(begins.repartition(parts, "_shard", "_bucket").groupBy("_shard", "_bucket")).applyInPandas(shuffle, schema).drop("_order")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of their slots within each file.

    shuffled is external_shuffle()'s result, whatever its other columns; ids and texts may be null or repeat. An empty
    table writes no shard.
    """
    shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = external_shuffle(docs)
    return out.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", "grown_shard", "bucket")
