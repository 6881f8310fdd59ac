"""Operator 10: mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import settle

#: Up to so many sources their table is broadcast; of more, those that one row in so many has at least.
SOURCES, COMMON = 1_000_000, 200
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with target and rate.

    Sources in code point order, null last, weigh weights in turn. They share budget times the whole size by weight; a
    target stops at most times its source's size and the excess goes to the others by weight. This is water-filling: in
    the order of size over weight, the sources up to some place are full and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    size, w = F.col("source_size").cast("double"), F.col("weight")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("level", F.lit(most) * size / w)
    ahead = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(budget) * F.sum(size).over(every) - F.lit(most) * F.coalesce(F.sum(size).over(ahead), F.lit(0.0))
    share = ranked.withColumn("share", left / F.sum(w).over(after))
    # the first source, in this order, whose level is not below the share sets the water level
    water = share.withColumn("water", F.max(F.when(F.col("level") >= F.col("share"), F.col("share"))).over(every))
    target = F.least(F.lit(most) * size, F.coalesce(F.col("water"), F.col("level")) * w)
    return water.select("source", "source_size", target.alias("target"), F.when(size > 0, target / size).otherwise(0.0).alias("rate"))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies: floor(rate) copies and one more if the document's hash says so.

    The extra copy is a Bernoulli draw whose probability is the fraction of the rate; the hash of seed and doc_id decides
    it, so reruns agree and rows of one doc_id share their draw. Null text has size 0. A null source is a source. An
    empty table gives no rows. Columns named like an added one are replaced; others stay. The sources are counted, and
    their table is broadcast, so that no text moves; beyond SOURCES only the common ones are, and the rows of the others
    meet theirs by a shuffle in which no source has more than one row in COMMON.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    sized = docs.withColumn("size", word_count(F.col("text")))
    sizes = settle(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    per = targets(sizes, weights, budget, most).withColumnRenamed("source", "_source")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    extra = (draw < F.col("rate") - F.floor("rate")).cast("long")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sizes.count() <= SOURCES:
        met = sized.join(F.broadcast(per), same)
    else:
        least = sizes.agg(F.sum("_rows")).first()[0] / COMMON
        often = sizes.where(F.col("_rows") >= least).select(F.col("source").alias("_often"))  # COMMON at most
        of = lambda c: F.col(c).eqNullSafe(F.col("_often"))
        common = sized.join(F.broadcast(per.join(F.broadcast(often), of("_source"), "left_semi")), same)
        met = common.unionByName(sized.join(F.broadcast(often), of("source"), "left_anti").join(per.join(F.broadcast(often), of("_source"), "left_anti"), same))
    return met.withColumn("copies", F.floor("rate") + extra).drop("_source")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows and columns, each as many times as plan() says."""
    columns = docs.columns
    return plan(docs, **how).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per),
l AS (SELECT *, 2.0::DOUBLE * source_size::DOUBLE / weight AS level FROM w),
sh AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER ()
    - 2.0::DOUBLE * coalesce(sum(source_size::DOUBLE) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
wa AS (SELECT *, max(CASE WHEN level >= share THEN share END) OVER () AS water FROM sh),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size::DOUBLE, coalesce(water, level) * weight) AS target FROM wa),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM t)
SELECT s.doc_id, s.size, r.source_size, r.target,
    s.size * (floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
"""
