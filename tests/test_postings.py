"""The kept index: equal to BM25 question by question, segment by segment, and what a question leaves unread."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import tokens
from ledgerlake.operators import retrieve
from ledgerlake.sources import postings


def by_hand(docs, questions, k):
    out = set()
    for q in questions.where("question_id IS NOT NULL").select("question_id", tokens(F.col("text")).alias("t")).collect():
        scores = retrieve.bm25(docs, list(q["t"] or []), "doc_id").select("doc_id", F.round("bm25", 6).alias("s"))
        out |= {(q["question_id"], r["doc_id"], r["s"]) for r in scores.orderBy(F.desc("s"), "doc_id").limit(k).collect()}
    return out


def found(index, questions, k):
    return {(r["question"], r["key"], round(r["score"], 6)) for r in index.search(questions, k).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    i = F.col("id")
    many = F.array_join(F.transform(F.sequence(F.lit(1), i % 23 + 1), lambda x: F.concat(F.lit("w"), (x * x + i) % 41)), " ")
    common = F.when(i % 3 != 0, " the").otherwise("")
    return spark.range(1500).select(i.alias("doc_id"), F.when(i % 200 != 7, F.concat(many, common, F.when(i % 90 == 0, " rare rare").otherwise(""))).alias("text"))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "W3 w4 w4"), (2, "rare"), (3, "the w9"), (4, "nowhere"), (5, ""), (6, None), (None, "w1"), (7, "rare w1 w2 w3 w5 w8 the")], "question_id int, text string")


def test_equals_bm25(spark, tmp_path, docs, questions):
    folder = str(tmp_path)
    assert postings.add(docs, folder, "a") == 1500
    assert found(postings.Index(spark, folder), questions, 7) == by_hand(docs, questions, 7)


def test_segments(spark, tmp_path, docs, questions):
    folder = str(tmp_path)
    assert postings.add(docs.where("doc_id < 900"), folder, "a") == 900
    old = {*spark.read.parquet(f"{folder}/a/postings").inputFiles()}
    assert postings.add(docs.where("doc_id >= 700"), folder, "b") == 600  # 200 of them are there
    assert postings.add(docs, folder, "b") == 0
    assert old == {*spark.read.parquet(f"{folder}/a/postings").inputFiles()}
    assert found(postings.Index(spark, folder), questions, 5) == by_hand(docs, questions, 5)


def test_leaves_chunks_unread(spark, tmp_path):
    folder, i = str(tmp_path), F.col("id")
    docs = spark.range(20000).select(i.alias("doc_id"), F.concat(F.lit("common "), F.when(i % 5000 == 1, "rare").otherwise("other"), F.repeat(F.lit(" x"), (i % 4).cast("int"))).alias("text"))
    postings.add(docs, folder, "a")
    q = spark.createDataFrame([(1, "common rare")], "question_id int, text string")
    index = postings.Index(spark, folder)
    chunks = spark.read.parquet(f"{folder}/a/postings").select("chunk").distinct().count()
    assert chunks > 40 and index.plan(q, 3)[2].count() < chunks / 4
    assert found(index, q, 3) == by_hand(docs, q, 3)
    heads = spark.read.parquet(f"{folder}/a/postings").where("term = 'rare'")
    assert "EqualTo(term,rare)" in heads._jdf.queryExecution().toString()


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        postings.Index(spark, folder).search(spark.createDataFrame([(1, "a")], "question_id int, text string"), 1)
    assert postings.add(spark.createDataFrame([], "doc_id long, text string"), folder, "none") == 0
    q = spark.createDataFrame([(1, "a b")], "question_id int, text string")
    assert postings.Index(spark, folder).search(q, 3).count() == 0
    with pytest.raises(ValueError):
        postings.add(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"), folder, "twice")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a"), (5, "b " * 5000), (6, "c"), (7, "d"), (8, "e"), (None, "a")], "doc_id long, text string")
    assert postings.add(docs, folder, "x") == 8
    assert found(postings.Index(spark, folder), q, 3) == by_hand(docs.where("doc_id IS NOT NULL"), q, 3)


def test_texts_are_cut_up_once(spark, tmp_path, docs):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert postings.add(docs.mapInArrow(counted, docs.schema), str(tmp_path), "a") == 1500
    assert seen.value == 1500


def test_scores_of_a_group_are_its_best(spark, tmp_path, monkeypatch, docs):
    """A group of chunks gives the k best of each question, not a row for each document; blocks of questions and keys of text change nothing."""
    folder, i = str(tmp_path), F.col("doc_id")
    named = docs.withColumn("doc_id", F.concat_ws("_", F.lit("k"), (i % 7).cast("string"), i.cast("string")))
    monkeypatch.setattr(postings, "QUESTIONS", 2)
    postings.add(named, folder, "a")
    q = spark.createDataFrame([(n, f"the w{n} w{n} w{n + 1}") for n in range(6)], "question_id int, text string")
    index = postings.Index(spark, folder)
    asked, first, left = index.plan(q, 3)
    groups, chunks = 2 * spark.sparkContext.defaultParallelism, left.select("chunk").distinct().count()
    scored = index._scores(asked, left, 3).groupBy("question").count().collect()
    assert chunks > 5 and scored and all(r["count"] < min(chunks, groups) * 10 for r in scored)
    got = {(r["question"], r["key"], round(r["score"], 6)) for r in index.search(q, 3).collect()}
    assert got == by_hand(named, q, 3)
