"""Reading records, leads, labels and registries (SRC). Schemas are declared; bad values become null or a default."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import iso_date
from ..functions.text import split_list
from ..schemas import CONFIDENCE_RANK, DELIVERY, LABEL, MFO, RECORD, SFO, SOURCE_CLASSES, UNDETERMINED
from .archives import zipped_csv, zipped_text  # noqa: F401


def verification(cell: Column, as_of: Column) -> Column:
    """A source for each class whose label stands in a cell. (SRC-04)"""
    found = F.filter(F.array(*[F.lit(v) for v in SOURCE_CLASSES.values()]), lambda v: F.contains(F.coalesce(cell, F.lit("")), v))
    return F.transform(found, lambda v: F.struct(v.alias("source_class"), F.lit("delivered").alias("verifies"), as_of.alias("accessed_at"), F.lit(None).cast("string").alias("url")))


def _one_of(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def delivered(spark: SparkSession, path: str, as_of: str, all_columns: bool = True) -> DataFrame:
    """The delivered CSV as nested records. (SRC-01)

    Unknown types, classes and dates get their defaults. all_columns=False leaves out the contact columns, the type's
    confidence and the notes, as the older loader did.
    """
    rows = spark.read.csv(path, header=True, schema=DELIVERY, multiLine=True, escape='"')
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    day = F.lit(as_of).cast("date")
    dated = iso_date(F.col("data_as_of"), day)
    contact = ("principal_email", "principal_email_status", "firm_contact_email", "firm_contact_email_status", "reviewer_notes")
    slot = lambda i: F.when(text(f"recent_signal_{i}").isNotNull(), F.struct(
        F.col(f"recent_signal_{i}").alias("text"),
        F.when(F.contains(f"recent_signal_{i}_source", F.lit("sec.gov")), SOURCE_CLASSES["SEC_EDGAR"]).otherwise(SOURCE_CLASSES["NEWS"]).alias("source_class"),
        iso_date(F.col(f"recent_signal_{i}_date")).alias("event_date"), text(f"recent_signal_{i}_source").alias("source_url"), F.lit("Medium").alias("confidence")))
    value = {
        "fo_id": F.col("fo_id"), "name": F.col("family_office_name"), "fo_type": _one_of(F.col("fo_type"), (SFO, MFO, UNDETERMINED), UNDETERMINED), "fo_type_evidence": text("classification_evidence"),
        "fo_type_confidence": _one_of(F.col("fo_type_confidence"), CONFIDENCE_RANK, "Low"), "investing_sectors": split_list(F.col("investing_sectors")), "signals": F.array_compact(F.array(*[slot(i) for i in (1, 2, 3)])),
        "discovery_source": _one_of(F.col("discovery_source"), SOURCE_CLASSES.values(), SOURCE_CLASSES["OTHER"]), "verification_sources": verification(F.col("verification_sources"), dated),
        "record_confidence": _one_of(F.col("record_confidence"), CONFIDENCE_RANK, "Low"), "data_as_of": dated, "could_not_verify": split_list(F.col("could_not_verify")), "provenance": F.lit(None)}
    out = []
    for f in RECORD.fields:
        c = value.get(f.name)
        if c is None:
            c = text(f.name)
        if not all_columns and f.name in contact:
            c = F.lit(None)
        if not all_columns and f.name == "fo_type_confidence":
            c = F.lit("Low")
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def store(spark: SparkSession, path: str) -> DataFrame:
    """The JSON store of records, lossless. (SRC-02)"""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def csv_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV rows as text. (SRC-03)"""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema) if schema else spark.read.csv(path, header=True, multiLine=True, escape='"')


LEAD = "candidate_name string, possible_type string, country string, city string, website string, discovery_source string, discovery_reason string, discovery_cycle string, _source_country string, verified_email array<string>, phone_numbers array<string>, contact_address string, verification_status string"


def leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads from JSON lines, those with a name; the line itself is kept as raw. (SRC-05)"""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("r", F.from_json("value", LEAD))
    return rows.where(F.trim("r.candidate_name") != "").select("r.*", F.col("value").alias("raw"))


def consolidated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(leads, counts): all cycles' leads, the first of each name, and how many lines were malformed or nameless. (SRC-06)

    A name is the same whatever its case and spaces; the first in the order of files and lines wins.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")).where(F.trim("value") != "")
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull()).withColumn("r", F.when(F.col("ok"), F.from_json("value", LEAD)))
    named = F.coalesce(F.trim("r.candidate_name") != "", F.lit(False))
    counts = parsed.agg(F.count("*").alias("lines"), F.count_if(~F.col("ok")).alias("malformed"), F.count_if(F.col("ok") & ~named).alias("skipped"))
    key = F.trim(F.regexp_replace(F.lower("r.candidate_name"), r"\s+", " "))
    rows = parsed.where(F.col("ok") & named).withColumn("_k", key).withColumn("cycle", F.coalesce("r.discovery_cycle", F.regexp_extract("file", r"^([^.]+)", 1)))
    first = rows.groupBy("_k").agg(F.min_by(F.struct("r", "cycle"), F.struct("file", "_block", "_line")).alias("x"))
    return first.select("x.r.*", "x.cycle"), counts


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON lines with # comments. (SRC-07)"""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return rows.select(F.from_json("value", LABEL).alias("r")).where("r.firm_name IS NOT NULL").select("r.*")


def table(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """A stored table, in order if one is asked for. (SRC-08)"""
    rows = spark.read.parquet(path)
    return rows.orderBy(order) if order else rows


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, parts: int = 1, low: int = 0, high: int = 0, **options: str) -> DataFrame:
    """A table of a database, read in parts by a numeric column. (SRC-08)"""
    split = {"column": column, "lowerBound": low, "upperBound": high, "numPartitions": parts} if column else {}
    return spark.read.jdbc(url, name, properties=options, **split)


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan. (SRC-09)"""
    return rows.where(F.col(key) == value)


def qualifying(rows: DataFrame) -> DataFrame:
    """Rows with evidence. (SRC-10)"""
    return rows.where(F.coalesce(F.col("fo_type_evidence") != "", F.lit(False)))


def adviser_filings(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Registry bulk CSV in Latin-1, chosen columns under new names, without quotes. (SRC-11)"""
    rows = spark.read.csv(path, header=True, encoding="ISO-8859-1", quote='"')
    return rows.select(*[F.trim(F.regexp_replace(F.col(f"`{old}`"), '^"|"$', "")).alias(new) for old, new in columns.items()])


def lookup(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object of objects as (key, fields). (SRC-12)"""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v"))
    return rows.select(key, "v.*")


def policy(text: str) -> dict:
    """A policy document; it is small and stays on the driver. (SRC-13)"""
    return json.loads(text)


def best_page(pages: DataFrame, site: str = "site", path: str = "path", priority: tuple[str, ...] = ("", "about", "contact", "team")) -> DataFrame:
    """The first page with text of each site, in the order of paths; contacts that it lacks come from the next. (SRC-22)"""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(path)), F.lit(0)), F.lit(len(priority) + 1))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), rank)).alias(c)
    return pages.groupBy(site).agg(*[first(c) for c in pages.columns if c not in (site, path)])
