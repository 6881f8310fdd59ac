"""Operator 11 against brute force, with copies over many tasks."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import interaction

SCHEMA = "doc_id long, text string, lang string"


def mask_of(rows, i):
    d, t, _ = rows[i]
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    copy = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in rows)
    tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), copy)
    return "".join(c for c, f in zip("ABCDE", tests, strict=True) if f)


def brute(rows, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1} - {None} for k in (0, 1))
    fails = [(d, lang or "", mask_of(rows, i)) for i, (d, _, lang) in enumerate(rows)]
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(d, m) for d, p, m in fails if p == part]
        shapley = collections.Counter()
        for o in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                earlier = [x for x in mine if f in x[1] and set(o[:k]) & set(x[1])]
                shapley[f] += len(gone)
                out[part, "".join(o), k + 1] = [len(kept), len(gone), len(earlier), sum(m == f for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                left = kept
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley[o[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


LONG = " ".join(f"word{i}é" for i in range(230))
ROWS = (
    [(i, "same text", "en") for i in range(40, 0, -1)]  # one text over many tasks
    + [(7, "same text", "de"), (7, "same text", "de"), (1, "same text", None), (None, "same text", "en"), (None, "same text", "en")]
    + [(100 + i, LONG, "fr") for i in range(5)] + [(110, LONG + " ABC" * 200, "fr"), (111, LONG + " a|b", "fr"), (112, "same " * 400, "fr")]
    + [(200, None, None), (201, "", ""), (202, None, "en"), (203, "É" * 9 + "A", "en"), (204, "  \t\n", "en"), (205, "x" * 300_000, "es"), (300, "alone", "es"), (None, "null and alone", None)]
)
LABELS = [(1, 1, 0), (1, 0, None), (5, 1, 1), (101, None, 1), (112, 0, 1), (999, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_against_brute_force(spark, parts):
    """With 23 tasks for 58 rows, runs of one text go on over tasks, end in them and leave tasks without rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
        docs = docs.withColumns({c: F.lit("mine") for c in ("mask", "part", "fp", "pid", "open", "first", "n", "_id")})
        labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))
        assert told(interaction.audit(docs, labels)) == brute(ROWS, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches_and_seams(spark):
    """Runs that go on from one Arrow batch to the next."""
    rows = [(i, f"text {i // 7}", "en") for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert told(interaction.audit(spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == brute(rows, [])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert interaction.audit(none, labels).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"\x80ab"), "en"), (2, bytearray(b"\x80ab"), "en"), (3, bytearray(b"\x81ab"), "en")], "doc_id long, text binary, lang string").withColumn("text", F.col("text").cast("string"))
    rows = told(interaction.audit(bad, labels))
    assert rows["en", "EABCD", 1][:2] == (2, 1)


def test_other_filters(spark):
    """Two filters of one's own, no duplicates: two orders of two steps."""
    rows = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "b"), (4, None)], "doc_id long, text string")
    out = interaction.audit(rows, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), {"X": F.contains("text", F.lit("a")), "Y": F.contains("text", F.lit("b"))}, None, F.lit("all"))
    assert told(out) == {
        ("all", "XY", 1): (2, 2, 0, 1, 1, 0, 3), ("all", "XY", 2): (1, 1, 1, 1, 0, 0, 3),
        ("all", "YX", 1): (2, 2, 0, 1, 0, 0, 3), ("all", "YX", 2): (1, 1, 1, 1, 1, 0, 3)}
