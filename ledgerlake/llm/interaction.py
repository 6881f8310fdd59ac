"""Operator 11: what filters remove in every order, alone and together; duplicates found by a sort over all rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import settle, small_batches

WORD = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters that need nothing but the text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def _marked(bit: int):
    """Rows sorted by fingerprint, text and doc_id, as (doc_id, part, mask, pid, open) and a row (pid, first, last) for the partition.

    bit is set in mask where the row's text begins with a smaller doc_id in this partition. open says that the row has the
    first doc_id of the partition's first text, so that the partition before decides.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before, first, last, head = TaskContext.get().partitionId(), None, None, None, True
        leader: int | None = None  # the first doc_id of the run of equal texts that goes on
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            fp, text, doc = b.column("fp"), b.column("text"), b.column("doc_id")
            same = np.zeros(n, bool)
            same[1:] = pc.and_(pc.equal(fp.slice(1), fp.slice(0, n - 1)), pc.equal(text.slice(1), text.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            same[0] = before is not None and before == (fp[0], text[0])
            begins = np.flatnonzero(~same)
            known, value = doc.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(doc, 0).to_numpy()
            run = np.cumsum(~same)  # 0: the run that the batch before left open
            leads, has = np.concatenate([[leader or 0], value[begins]]), np.concatenate([[leader is not None], known[begins]])
            fails = known & has[run] & (value > leads[run])
            top = (run == (0 if same[0] else 1)) if head else np.zeros(n, bool)  # the partition's first run
            head = head and bool(top.all())
            undecided = top & known & has[run] & ~fails
            mask = b.column("mask").to_numpy() | np.where(fails, bit, 0)
            none = pa.nulls(n, pa.binary())
            yield pa.record_batch([doc, b.column("part"), pa.array(mask, pa.int32()), pa.array(np.full(n, pid), pa.int32()), pa.array(undecided), none, none], NAMES)
            leader = int(leads[run[-1]]) if has[run[-1]] else None
            before, last = (fp[n - 1], text[n - 1]), fp[n - 1].as_py()
            first = fp[0].as_py() if first is None else first
        if first is not None:
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([pid], pa.int32()), pa.nulls(1, pa.bool_()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], NAMES)

    return mark


NAMES = ["doc_id", "part", "mask", "pid", "open", "first", "last"]
MARKED = "doc_id long, part string, mask int, pid int, open boolean, first binary, last binary"


def masks(docs: DataFrame, fails: dict[str, Column], duplicates: str | None, part: Column) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id fail the same filters. Bit i of mask is the i-th filter, duplicates the last.

    All rows are dealt to tasks by range of (fingerprint, doc_id) and sorted there by fingerprint, text and doc_id, so a
    row's duplicate stands before it and copies of one text, however many, spread over tasks. The fingerprint is SHA-256 of
    the text's bytes. Neighbours within a task are compared text by text. What is open at a task's edge is one doc_id of
    one text: it fails if the task before ended with the same fingerprint, as equal (fingerprint, doc_id) are of one task.
    """
    bit = 1 << len(fails)
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0)).cast("int")
    ids = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), part.alias("part"))
    if duplicates is None:
        return rows.select("doc_id", "part", mask.alias("mask")).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    dealt = rows.withColumn("fp", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).repartitionByRange("fp", ids).sortWithinPartitions("fp", "text", ids)
    with small_batches(docs.sparkSession):
        marked = settle(dealt.select("fp", F.col("text").cast("binary").alias("text"), "doc_id", "part", mask.alias("mask")).mapInArrow(_marked(bit), MARKED))
    edges = marked.where("first IS NOT NULL").select("pid", (F.lag("last").over(Window.orderBy("pid")) == F.col("first")).alias("goes_on"))  # a row for each task
    joined = marked.where("first IS NULL").join(F.broadcast(edges), "pid", "left")
    late = F.when(F.col("open") & F.coalesce("goes_on", F.lit(False)), bit).otherwise(0)
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask")).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))


def effects(spark: SparkSession, letters: str) -> DataFrame:
    """What a document with a given mask counts for at each step of each order: 2**n * n! * n rows for n filters, whatever the data."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    steps = [("".join(o), k + 1, bit[c], sum(bit[x] for x in o[:k])) for o in itertools.permutations(letters) for k, c in enumerate(o)]
    rows = spark.createDataFrame(steps, "filter_order string, step int, own int, earlier int")
    mask, own, earlier = F.col("mask"), F.col("own"), F.col("earlier")
    has = lambda bits: mask.bitwiseAND(bits) != 0
    # of the orders, one in as many as filters that a document fails has a given one of these first
    share = F.floor(F.lit(math.factorial(len(letters))) / F.bit_count(mask))
    return rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1)))).select(
        "filter_order", "step", F.col("mask").alias("_mask"),
        (~has(own.bitwiseOR(earlier))).cast("long").alias("_kept"), (has(own) & ~has(earlier)).cast("long").alias("_removed"), (has(own) & has(earlier)).cast("long").alias("_redundant"),
        (mask == own).cast("long").alias("_alone"), F.when(has(own), share).otherwise(0).cast("long").alias("_share"))


def audit(docs: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, duplicates: str | None = "E", part: Column | None = None) -> DataFrame:
    """One row per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs(doc_id, text, lang): null text is empty, a null language is the part "". fails are conditions on text by letter;
    duplicates, if not None, is the letter of the filter that fails a row if a smaller doc_id has the same text. A null
    doc_id is neither smaller nor larger than any, so such rows never fail as copies; rows that agree in doc_id and text
    are no copies of each other. labels(doc_id, quality, toxic): a row is good or toxic if any label of its id says 1.
    Counters are sums over masks of failures, so rows meet by part and mask only, after a sum in each task. An empty table
    has no part and gives no rows. Other columns are ignored, whatever their names.
    """
    fails = failures(F.col("text")) if fails is None else fails
    letters = "".join(fails) + (duplicates or "")
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")) if part is None else part
    counted = masks(docs, fails, duplicates, part)
    good, toxic = (F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")) for c in ("quality", "toxic"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(good.alias("_good"), toxic.alias("_toxic"))
    n = F.col("n")
    known = counted.join(said, F.col("doc_id") == F.col("_id"), "left")
    sums = known.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(n * F.coalesce("_good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    told = sums.join(F.broadcast(effects(docs.sparkSession, letters)), F.col("mask") == F.col("_mask"))
    of = lambda c, by="n": F.sum(F.col(by) * F.col(c)).cast("long")
    return told.groupBy("part", "filter_order", "step").agg(
        of("_kept").alias("kept"), of("_removed").alias("removed"), of("_redundant").alias("redundant"), of("_alone").alias("unique_fails"),
        of("_removed", "good").alias("good_lost"), of("_removed", "toxic").alias("toxic_lost"), of("_share").alias("shapley"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN said ON f.doc_id = said.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders(o) AS (SELECT letter FROM letters UNION ALL SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter) AND length(o) < 5),
steps AS (SELECT o, k::INT AS step, substr(o, k, 1) AS own, substr(o, 1, k - 1) AS earlier FROM orders, range(1, 6) r(k) WHERE length(o) = 5),
x AS (SELECT part, o AS filter_order, step, n, good, toxic, own, contains(fails, own) AS hit, length(fails) AS k,
    length(translate(fails, earlier, '')) < length(fails) AS gone, fails = own AS alone FROM m, steps),
y AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""
