"""Trust across cycles as a stream: each firm's last snapshot is kept in a store in buckets, and what changed comes out. (CYC-01 to CYC-03, CYC-06)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.classify import trust_reason
from ..operators.lineage import stored
from ..schemas import TRUST_FIELDS
from ..sources import buckets
from .events import each_batch

#: A drop: a snapshot of the released firms, with the number of its cycle.
DROP = "fo_id string, " + ", ".join(f"{f} string" for f in TRUST_FIELDS) + ", n_sources int, cycle long"
FIELDS = (*TRUST_FIELDS, "n_sources")


def against_last(rows: DataFrame, last: DataFrame | None) -> DataFrame:
    """(fo_id, cycle, fields, was) for rows(fo_id, cycle, fields, place): was is the firm's snapshot before, of rows or else of last(fo_id, cycle, fields).

    Of a firm's rows of one cycle the first by place counts. Cycles that are not after the firm's last one were seen
    already and are left out, as are rows without a fo_id or a cycle. A firm's rows are as many as the drops have cycles.
    """
    known = rows.where("fo_id <> '' AND cycle IS NOT NULL")
    first = known.groupBy("fo_id", "cycle").agg(F.min_by(F.struct(*FIELDS), "place").alias("r")).select("fo_id", "cycle", "r.*")
    all_ = first.withColumn("_old", F.lit(False))
    if last is not None:
        all_ = all_.unionByName(last.join(known.select("fo_id"), "fo_id", "left_semi").withColumn("_old", F.lit(True)))
    firm = Window.partitionBy("fo_id")
    seen = F.max(F.when(F.col("_old"), F.col("cycle"))).over(firm)
    new = all_.withColumn("_seen", seen).where(F.col("_old") | F.col("_seen").isNull() | (F.col("cycle") > F.col("_seen")))
    was = F.lag(F.struct("cycle", *FIELDS)).over(firm.orderBy("cycle"))
    return new.withColumn("was", was).where("NOT _old").drop("_old", "_seen")


def changes(placed: DataFrame) -> DataFrame:
    """(fo_id, cycle, reason, changed) of against_last(): what differs from the cycle before, with the weightiest reason. A firm that a cycle left out begins anew, as it has nothing to contradict."""
    change = lambda f: F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f"was.{f}").cast("string").alias("was"), F.col(f).cast("string").alias("now")))
    fewer = F.coalesce("n_sources", F.lit(0)) < F.coalesce("was.n_sources", F.lit(0))
    rows = placed.where("was.cycle = cycle - 1").select("fo_id", "cycle", fewer.alias("fewer"), F.array_compact(F.array(*[change(f) for f in FIELDS])).alias("changed"))
    return rows.where(F.size("changed") > 0).select("fo_id", "cycle", trust_reason(F.col("fewer")).alias("reason"), "changed")


def advance(batch: DataFrame, number: int, target: str, state: str) -> None:
    """The changes of a batch of drops as target/batch=number, then the firms' last snapshots. A batch that broke off writes the same again; one that was done changes nothing."""
    spark, version = batch.sparkSession, f"v{number}"
    about = buckets.manifest(spark, state)
    if about is not None and version in about["versions"]:
        return
    placed = stored(against_last(batch, None if about is None else buckets.read(spark, state)))
    changes(placed).write.mode("overwrite").parquet(f"{target}/batch={number}")
    buckets.upsert(placed.drop("was").withColumn("_at", F.col("cycle")), state, "fo_id", "_at", version)


def follow(spark: SparkSession, drops: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Add the changes of all drops that came since the last call to target; a restart reads no drop twice.

    The state is a row for each firm ever seen, in buckets beside the checkpoint's log; a batch rewrites those it touches.
    """
    stream = spark.readStream.schema(DROP).option("maxFilesPerTrigger", files_per_batch).parquet(drops)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("place")
    each_batch(stream.select("*", place), lambda batch, number: advance(batch, number, target, f"{checkpoint}/firms"), checkpoint)
