"""A store of entities that grows batch by batch: labels persist, and a batch asks for its own identifiers only. (RES-02, RES-09, RES-10, SRC-25)

labels (id, root, batch) and keys (k, root, batch) are appended to, a folder for each batch; moves (old, new) says which roots
have met a smaller one since, and is the only table that is written anew. The pointer names the last batch that is whole,
so a batch that broke off is simply done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import few, stored
from ..operators.resolve import labels_of
from .sinks import pointer, put_pointer

_LABELS, _KEYS, _MOVES = "id long, root long, batch int", "k string, root long, batch int", "old long, new long"


def _last(spark: SparkSession, folder: str) -> int:
    found = pointer(spark, folder)
    return -1 if found is None else int(found)


def _table(spark: SparkSession, folder: str, name: str, schema: str, last: int) -> DataFrame:
    """All whole batches of a table; later ones are never opened."""
    if last < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch") <= last)


def _moves(spark: SparkSession, folder: str, last: int) -> DataFrame:
    return spark.createDataFrame([], _MOVES) if last < 0 else spark.read.schema(_MOVES).parquet(f"{folder}/moves/{last}")


def _now(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with root as it is after all moves."""
    return rows.join(few(moves), F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(id, root) of every row that has an identifier: the smallest id that shared identifiers connect it with, itself if none."""
    last = _last(spark, folder)
    return _now(_table(spark, folder, "labels", _LABELS, last).select("id", "root"), _moves(spark, folder, last))


def extend(rows: DataFrame, folder: str, batch: int, key: str = "ordinal", ids: str = "ids") -> int:
    """Add rows(key, ids, an array) as a batch, numbered from 0 on; how many roots moved. A batch that is there already changes nothing.

    A graph is made of the batch alone: its rows, each identifier's first row, and the root that an identifier has from
    before. Rows of earlier batches are not read; where the graph connects two old roots, the larger moves to the smaller.
    Batches in any order give what all rows at once give. Rows without identifiers are left out; a key should be new.
    """
    spark, last = rows.sparkSession, _last(rows.sparkSession, folder)
    if batch <= last:
        return 0
    moves = _moves(spark, folder, last)
    pairs = stored(rows.select(F.col(key).cast("long").alias("id"), F.explode(F.array_distinct(ids)).alias("k")).where("k IS NOT NULL"))
    first = few(pairs.groupBy("k").agg(F.min("id").alias("a")))
    known = _now(_table(spark, folder, "keys", _KEYS, last).select("k", "root").join(first.select("k"), "k", "left_semi"), moves)
    hubs = stored(first.join(known, "k", "left"))
    edges = pairs.join(few(hubs.select("k", F.col("a").alias("b"))), "k").where("id <> b").select(F.col("id").alias("a"), "b").union(hubs.where("root IS NOT NULL").select("a", F.col("root").alias("b")))
    nodes = pairs.select("id").union(hubs.where("root IS NOT NULL").select(F.col("root").alias("id"))).distinct()
    label = stored(labels_of(stored(edges.distinct()), nodes))
    moved = stored(hubs.where("root IS NOT NULL").select(F.col("root").alias("old")).distinct().join(label.select(F.col("id").alias("old"), F.col("root").alias("new")), "old").where("old <> new"))
    pairs.select("id").distinct().join(label, "id").write.mode("overwrite").parquet(f"{folder}/labels/batch={batch}")
    new = hubs.where("root IS NULL").select("k", F.col("a").alias("id")).join(label, "id").select("k", "root")
    new.write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")
    # a root that moved earlier follows the one that it moved to
    after = _now(moves.select("old", F.col("new").alias("root")).withColumnRenamed("old", "_o"), moved).select(F.col("_o").alias("old"), F.col("root").alias("new")).union(moved)
    after.write.mode("overwrite").parquet(f"{folder}/moves/{batch}")
    put_pointer(spark, folder, str(batch))
    return moved.count()
