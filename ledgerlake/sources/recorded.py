"""Discovery sources over recorded responses: Spark reads the pages, DataFrames make candidates (SRC-14 to SRC-20)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import norm_name, office_names, without_cik
from ..schemas import SOURCE_CLASSES
from ..streaming.events import each_batch
from .sinks import insert_new

SCHEMA = "name string, source_key string, source_url string, identifiers map<string,string>, hints map<string,string>, page long, place long"


class _Page(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _edgar(doc: dict):
    for h in doc.get("hits", {}).get("hits", []):
        s = h.get("_source", {})
        names, ciks = s.get("display_names") or [None], s.get("ciks") or [None]
        yield names[0], {"cik": ciks[0]} if ciks[0] else {}, {k: v for k, v in {"state": (s.get("biz_states") or [None])[0], "city": (s.get("biz_locations") or [None])[0]}.items() if v}, None


def _iapd(doc: dict):
    for h in doc.get("hits", {}).get("hits", []):
        s = h.get("_source", {})
        if "family office" in (s.get("firm_name") or "").lower():
            yield s["firm_name"], {"crd": str(s["firm_source_id"])} if s.get("firm_source_id") else {}, {}, None


def _nonprofit(doc: dict):
    for o in doc.get("organizations", []):
        yield o.get("name"), {"ein": str(o["ein"])} if o.get("ein") else {}, {k: v for k, v in (("state", o.get("state")), ("city", o.get("city"))) if v}, None


def _directory(doc: dict):
    for m in doc.get("query", {}).get("categorymembers", []):
        if not m.get("title", "").lower().startswith(("category:", "list of", "family office")):
            yield m["title"], {}, {}, None
    for b in doc.get("results", {}).get("bindings", []):
        get = lambda k, b=b: b.get(k, {}).get("value")
        yield get("itemLabel"), {"qid": get("item").rsplit("/", 1)[-1]} if get("item") else {}, {"country": get("countryLabel")} if get("countryLabel") else {}, get("website")


def _texts(doc: dict):
    for a in doc.get("articles", []) + doc.get("results", []) + doc.get("organic", []):
        yield " ".join(str(a.get(k) or "") for k in ("title", "content", "snippet", "text")), {}, {}, a.get("url") or a.get("link")


PARSERS = {"edgar": _edgar, "iapd": _iapd, "nonprofit": _nonprofit, "directory": _directory, "news": _texts, "search": _texts}
CLASSES = {"edgar": "SEC_EDGAR", "iapd": "SEC_IAPD", "nonprofit": "IRS_990PF", "directory": "DIRECTORY", "news": "NEWS", "search": "WEB"}


def candidates_of(kind: str, content: str, number: int):
    """The rows of one recorded page."""
    for i, (name, ids, hints, url) in enumerate(PARSERS[kind](json.loads(content))):
        if name:
            yield (name, next(iter(ids.values()), None), url, ids, hints, number, i)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.files = options["kind"], [p for p in options["paths"].split("\n") if p]

    def partitions(self):
        return [_Page(p, i) for i, p in enumerate(self.files)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            yield from candidates_of(self.kind, f.read(), partition.number)


class Recorded(DataSource):
    """format("recorded"): options kind and paths (one a line); a page is a partition.

    The point where a live source is put in: its reader opens pages on the executors, so paths must be on all of them, and
    one that is not there is an error. discover() reads through Spark instead.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def pages(spark: SparkSession, paths: list[str], missing: str = "error") -> DataFrame:
    """(page, content): recorded pages read by Spark, page their place in paths. A path that is not there is an error, or with missing="skip" no row."""
    if missing not in ("error", "skip"):
        raise ValueError("missing is error or skip")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    found = []
    for i, p in enumerate(paths):
        where = hadoop.Path(p)
        fs = where.getFileSystem(conf)
        if fs.exists(where):
            found.append((fs.makeQualified(where).toUri().toString(), i, p))
        elif missing == "error":
            raise FileNotFoundError(p)
    if not found:
        return spark.createDataFrame([], "page int, content string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    places = spark.createDataFrame([(u, i) for u, i, _ in found], "u string, page int")
    rows = spark.read.text(sorted({p for *_, p in found}), wholetext=True).select(F.col("value").alias("content"), plain(F.input_file_name()).alias("_u"))
    return rows.join(F.broadcast(places), plain(F.col("u")) == F.col("_u")).select("page", "content")  # a row for each path given


def _parsed(rows: DataFrame, kind: str) -> DataFrame:
    """rows(page, content) as candidates, with _k, by which a candidate is one."""

    kind_of_page = "string" if rows.isStreaming else "long"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for n, c in zip(b["page"], b["content"], strict=True) for r in candidates_of(kind, c, n)], columns=["name", "source_key", "source_url", "identifiers", "hints", "page", "place"])

    out = rows.mapInPandas(parse, SCHEMA.replace("page long", f"page {kind_of_page}"))
    if kind in ("news", "search"):
        out = out.withColumn("name", F.explode(office_names(F.col("name"))))
    return out.withColumn("name", without_cik(F.col("name"))).withColumn("_k", F.coalesce("source_key", norm_name(F.col("name")))).where("_k <> ''")


def follow(spark: SparkSession, kind: str, folder: str, store: str, checkpoint: str, files_per_batch: int = 1000, packed: bool = False) -> None:
    """Add the candidates of all pages that came to folder since the last call to store, each identifier or name once. (SRC-14 to SRC-20, CYC-04)

    A page is a file, or with packed a row {"page", "content"} of files of JSON lines: listing, logging and opening a file
    for each page is most of the time where pages are many.

    The pages are a stream of files, whose log in the checkpoint folder holds the offsets, so a restart reads no page
    twice; a batch that broke off is read again and adds what is not there yet. Within a batch the first page by name
    counts. The store is keyed by kind:identifier or kind:name.
    """
    stream = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    if packed:
        found = stream.schema("page string, content string").json(folder).where("page IS NOT NULL AND content IS NOT NULL")
    else:
        found = stream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("content"))
    rows = _parsed(found, kind)
    kept = rows.withColumn("key", F.concat(F.lit(f"{kind}:"), "_k")).withColumn("source_class", F.lit(SOURCE_CLASSES[CLASSES[kind]])).drop("_k")
    each_batch(kept, lambda batch, _: insert_new(batch.withColumn("_order", F.struct("page", "place")), store, "key", "_order") and None, checkpoint)


def discover(spark: SparkSession, kind: str, paths: list[str], limit: int | None = None, missing: str = "error") -> DataFrame:
    """Candidates of one kind of source, each identifier or name once, the first on its page. (SRC-14 to SRC-20)"""

    rows = _parsed(pages(spark, paths, missing), kind)
    others = [c for c in rows.columns if c != "_k"]
    first = rows.groupBy("_k").agg(F.min_by(F.struct(*others), F.struct("page", "place")).alias("r")).select("r.*")
    out = first.withColumn("source_class", F.lit(SOURCE_CLASSES[CLASSES[kind]])).orderBy("page", "place")
    return out.limit(limit) if limit is not None else out
