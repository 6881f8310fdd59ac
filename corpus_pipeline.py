"""A corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing. Each stage is an operator of ledgerlake.llm."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import mixing, neardup, packing, quality, repeats
from ledgerlake.llm._dist import settle


BASE = ("doc_id", "text", "lang", "source", "n_chars")


def documents_in_and_out(stage: Callable) -> Callable:
    """A stage that returns docs' columns, in their order. Columns besides BASE go through under other names, so none clashes with what an operator adds."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in BASE}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])

    return run


@documents_in_and_out
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier accepts.

    Null and empty texts, and those of a language without trusted texts, are kept. Rows of one id or text are judged each,
    and alike if text and language agree. A null lang is a language, a null id is never trusted. Labels of ids that are not
    there say nothing. Without labels, and on an empty table, nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels, carry=True).where("keep")


@documents_in_and_out
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, and of one id the text that hashes lowest.

    Rows that agree in id and text are one. Documents without words (null, empty, signs alone) are classes of their own
    unless their texts are equal; null and empty ones stay one for each id. A class of null ids keeps one row.
    """
    return neardup.deduplicate(docs)


@documents_in_and_out
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages. What a cut leaves of a character goes too; documents left empty go.

    Texts shorter than a passage, null and empty ones stay as they are. Equal long texts are repeats of each other and go
    whole, so near-duplicates should have gone before. Null and repeated ids play no part; n_chars follows the text.
    """
    out = repeats.remove_repeats(docs)
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    whole = (F.size("removed") == 0) | (F.octet_length("kept") > 0)
    kept = out.where(whole).withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


@documents_in_and_out
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate says.

    A null source is a source. Null and empty texts have size 0 but are drawn like others of their source, unless all of
    it is empty: then its rate is 0. Rows of one id share their draw.
    """
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, a row each.

    Null and empty texts are a piece of one end id; repeated rows, as mixing makes them, are packed each; longer documents
    than a sequence are cut; other columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the model, the signatures nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as a table and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
