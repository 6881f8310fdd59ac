"""Questions in words: a plan on the driver, DataFrames behind it (RAG-03, RAG-06, RAG-07, AGG-07, AGG-08)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import days_since, parse_aum
from ..functions.text import tokens
from ..operators import classify, compute, filters, retrieve
from ..operators.records import cards, document_text, metadata

# What a claim about all firms may be about, in the order in which subjects are tried.
SUBJECTS = (
    ("principal_email", r"principal\s*(?:e-?mail|email)", "a principal email"),
    ("principal_phone", r"principal\s*phone", "a principal phone number"),
    ("firm_contact_email", r"(?:firm|company|contact|general)\s*(?:e-?mail|email)", "a firm contact email (not a named-person route)"),
    ("website", r"website|web\s*site", "a website"),
    ("hq_phone", r"phone|telephone|hq\s*phone", "a head-office phone number"),
    ("13f", r"13f|13\(f\)|securit", "13F securities value on file"),
)


@dataclass
class Plan:
    """How a question is answered: universal, count, total, or retrieve."""

    mode: str
    query: str
    subject: str | None = None
    label: str = ""
    conditions: dict = field(default_factory=dict)
    measure: str | None = None


# Words that name a measure, the most telling first; assets without a basis are estimated wealth.
MEASURES = ((r"13f|13\(f\)", "13F_securities_value"), (r"regulatory|adv\b", "regulatory_aum"), (r"wealth|\baum\b|assets", "estimated_wealth"))


def plan(query: str) -> Plan:
    low = query.lower()
    ours = re.search(filters.DOMAIN_TERM, low)
    if re.search(filters.UNIVERSAL, low) and re.search(filters.HAS, low) and ours:
        for key, pattern, label in SUBJECTS:
            if re.search(pattern, low, re.I):
                return Plan("universal", query, key, label)
    found = filters.parse_filters(query)
    conditions = {k: v for k, v in found.items() if k in ("fo_type", "hq_state", "hq_country")}
    measure = next((m for pattern, m in MEASURES if re.search(pattern, low)), None)
    total = re.search(filters.TOTAL_INTENT, low) and not re.search(r"total number of", low) and measure
    count = re.search(filters.COUNT_INTENT, low) and ours
    if total or count:
        return Plan("both" if total and count else "total" if total else "count", query, conditions=conditions, measure=measure if total else None)
    return Plan("retrieve", query, conditions=found)


def measures(records: DataFrame) -> DataFrame:
    """(fo_id, amount, measure_type, as_of, source) of records' sizes."""
    return records.select("fo_id", parse_aum(F.col("estimated_aum")).alias("m")).where("m IS NOT NULL").select("fo_id", "m.*")


def aggregate(records: DataFrame, p: Plan) -> DataFrame:
    """One row for a universal, count or total plan."""
    if p.mode == "universal":
        has: Column = F.col("estimated_aum").rlike(r"(?i)13f|13\(f\)|securit") if p.subject == "13f" else filters.filled(F.trim(F.col(p.subject)))
        return records.agg(F.count_if(F.coalesce(has, F.lit(False))).alias("have_field"), F.count("*").alias("total")).withColumn("claim", F.lit(p.subject))
    if p.mode == "both":  # no part is dropped
        return compute.decompose({m: aggregate(records, replace(p, mode=m)) for m in ("count", "total")})
    if p.mode == "count":
        return compute.scoped_count(records, filters.matches(**p.conditions))
    return compute.typed_total(records, measures(records), filters.matches(**p.conditions), p.measure)


def state(p: Plan, row: dict) -> str:
    """The text of an aggregate answer."""
    if p.mode == "universal":
        return f"{row['have_field']} of {row['total']} family offices in the verified dataset have {p.label}."
    where = ", ".join(str(v) for v in p.conditions.values()) or "all records"
    if p.mode == "count":
        return f"{row['value']} of {row['total_records']} records qualify ({where})."
    return f"${row['value']:,.2f} {row['measure_type']} over {row['included_in_calc']} of {row['qualified']} qualified records ({where})."


def answer(records: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, k: int = 5, least: float = retrieve.LEAST_SIMILARITY) -> dict:
    """What a question's plan gives: aggregates over all records, or the cards of the best k and whether they suffice.

    vectors(fo_id, embedding, focus) and query_vector come from outside; without them only keywords rank. The driver
    gets k rows at most.
    """
    p = plan(query)
    if p.mode != "retrieve":
        parts = [replace(p, mode=m) for m in ("count", "total")] if p.mode == "both" else [p]
        rows = [aggregate(records, x).first().asDict() for x in parts]  # a row each
        said = " ".join(state(x, r) for x, r in zip(parts, rows, strict=True))
        return {"query": query, "answered": True, "mode": p.mode, "answer": said, "compute": rows[0] if len(rows) == 1 else {x.mode: r for x, r in zip(parts, rows, strict=True)}, "citations": [], "cards": []}
    docs = records.select("fo_id", "name", document_text().alias("text"))
    words = [r["t"] for r in records.sparkSession.range(1).select(F.explode(tokens(F.lit(query))).alias("t")).collect()]
    scores = docs.select("fo_id").join(retrieve.bm25(docs, words, "fo_id"), "fo_id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    if vectors is not None and query_vector is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        scores = scores.join(vectors.select("fo_id", retrieve.dot_product(F.col("embedding"), q).alias("vector"), retrieve.dot_product(F.col("focus"), q).alias("focus")), "fo_id")
    else:
        scores = scores.withColumn("vector", F.lit(0.0)).withColumn("focus", F.lit(0.0))
    found = retrieve.hybrid(metadata(records).join(records.select("fo_id", "name"), "fo_id"), scores, filters.meta_matches(p.conditions) if p.conditions else None, "fo_id", "fo_id", k)
    found = found.select("fo_id", "name", "vector_score", "bm25", "rrf").withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf"), "fo_id")))
    kept = found.collect()  # k rows
    spark = records.sparkSession
    few = spark.createDataFrame(kept, found.schema)
    verdict = retrieve.assess(few, query, bool(p.conditions), least).first()
    if not verdict["answerable"]:
        return {"query": query, "answered": False, "mode": "abstain", "answer": "", "reason": verdict["reason"], "citations": [], "cards": []}
    shown = few if p.conditions or not any(r["vector_score"] >= least for r in kept) else few.where(F.col("vector_score") >= least)
    rows = shown.select("fo_id", "place").join(cards(records), "fo_id")
    text = retrieve.extractive(rows).first()
    return {"query": query, "answered": True, "mode": "extractive", "answer": text["answer"], "reason": verdict["reason"], "citations": list(text["citations"]), "cards": [r.asDict() for r in rows.orderBy("place").collect()]}


KEYWORDS = {"healthcare": "healthcare", "biotech": "healthcare", "technology": "technology", "tech": "technology", "real estate": "real estate", "energy": "energy", "venture": "venture", "private equity": "private equity", "impact": "impact"}


def understand(goal: str) -> dict:
    """Sectors and places of a mandate by keywords. (CLS-08)"""
    low = goal.lower()
    found = filters.parse_filters(goal)
    return {"sectors": sorted({v for k, v in KEYWORDS.items() if re.search(rf"\b{re.escape(k)}\b", low)}), "geography": [v for k, v in found.items() if k in ("hq_state", "hq_country")]}


def rank(records: DataFrame, criteria: dict, as_of: str, top: int = 5) -> DataFrame:
    """Records by fit to a mandate: score, uncertainty, route and a stated reason. (RAG-06, RAG-07, JOIN-16, SRT-02)

    Every record is scored, so passes by meaning would not change which records are ranked. Where places are asked for,
    only records there are.
    """
    sectors, places = list(criteria.get("sectors") or []), list(criteria.get("geography") or [])
    route = classify.contact_route()
    rows = records.select(
        "fo_id", "name", "fo_type", "fo_type_evidence", "record_confidence", "investment_thesis", classify.sector_match(sectors).alias("sector_match"), classify.place_match(places).alias("geography_match"),
        F.coalesce(F.size("verification_sources"), F.lit(0)).alias("n_sources"), F.coalesce(F.size("signals"), F.lit(0)).alias("n_signals"), route.alias("contact_route"), route.isNotNull().alias("has_route"),
        days_since(F.col("data_as_of").cast("string"), F.lit(as_of).cast("date")).alias("days"))
    if places:
        rows = rows.where("geography_match")
    scored = classify.fit(rows, bool(sectors), bool(places)).orderBy(F.desc("fit_score"), "fo_id").limit(top)
    why = F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise("all evidence that the mandate asks for is on file")
    return scored.withColumn("explanation", F.concat(F.col("name"), F.lit(": "), F.col("uncertainty"), F.lit(" evidence; "), why))
