"""Hybrid retrieval (RAG, NUM-05 to NUM-07, TXT-27): filter, three channels, ranks, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import cosine, dot, norm, rrf
from ..functions.text import name_core, norm_name, overrides_instructions, tokens
from .lineage import cut
from .relations import numbered

# Tokens that many firm names share, which never ground a name.
GENERIC = {
    "family", "office", "offices", "capital", "partners", "partner", "management", "advisors", "advisor", "advisory", "group", "llc", "lp", "inc", "ltd", "the", "and", "of", "co",
    "holdings", "ventures", "associates", "wealth", "investments", "investment", "single", "multi", "type", "types", "assets", "under", "regulatory", "services", "service", "portfolio",
    "risk", "private", "global", "financial", "solutions", "strategies", "strategy", "planning", "legacy", "enterprise", "intergenerational", "outsourced", "virtual", "embedded",
    "commercial", "traditional", "hybrid", "dedicated", "boutique", "independent", "professional", "direct", "unified", "integrated", "modern", "typical", "classic", "common",
    "structured", "form", "forms",
}
LEAST_SIMILARITY = 0.68


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(key, bm25) for the documents that have a query term; idf is of all of docs. (NUM-06)

    Documents are tokenised once, and what is kept of each is its length and the query's terms in it. A negative idf becomes epsilon times the mean
    idf of all terms. That mean needs the document frequency of every term, so it is only taken if some term of the query
    is in more than half of the documents.
    """
    words = [F.lit(w) for w in dict.fromkeys(query)]
    wanted = [*dict.fromkeys(query)]
    cut_up = docs.select(key, tokens(F.col(text)).alias("_t"))
    sized = cut(cut_up.select(key, F.size("_t").alias("_n"), F.filter("_t", lambda t: t.isin(wanted)).alias("_hits")))
    stats = sized.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"))
    terms = sized.select(key, "_n", F.explode("_hits").alias("term")).groupBy(key, "_n", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).withColumn("idf", F.log(F.col("_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # as many rows as the query has terms
    if words and idf.where("idf < 0").limit(1).count():
        every = cut_up.select(key, F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = every.join(F.broadcast(stats)).agg(F.avg(F.log(F.col("_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("_mean_idf"))
        idf = idf.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, F.lit(epsilon) * F.col("_mean_idf")).otherwise(F.col("idf")))
    per_term = {w: query.count(w) for w in dict.fromkeys(query)}
    times = F.create_map(*[x for w, n in per_term.items() for x in (F.lit(w), F.lit(n))]) if per_term else F.lit(None).cast("map<string,int>")
    part = F.col("idf") * F.try_element_at(times, F.col("term")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    return terms.join(F.broadcast(idf), "term").groupBy(key).agg(F.sum(part).alias("bm25"))


def cosine_to(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """vectors with cosine to one query vector. (NUM-05)"""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("cosine", cosine(F.col(column), q))


def hybrid(meta: DataFrame, scores: DataFrame, allowed: Column | None = None, key: str = "doc_id", ordinal: str = "doc_id", k: int = 5, rrf_k: int = 60) -> DataFrame:
    """The k best rows by fused rank: scores(key, vector, focus, bm25) over the allowed rows of meta. (RAG-01, RAG-02, WIN-01)

    BM25 and focus rank only rows with a positive score; the vector channel ranks all. vector_score is the better of
    vector and focus. Each channel is ranked over its own rows by numbered().
    """
    rows = cut((meta if allowed is None else meta.where(allowed)).join(scores, key))
    fused = numbered(rows, [F.desc("vector"), ordinal], "v_rank")
    for channel, name in (("bm25", "b_rank"), ("focus", "f_rank")):
        hits = numbered(rows.where(F.col(channel) > 0).select(key, ordinal, channel) if key != ordinal else rows.where(F.col(channel) > 0).select(key, channel), [F.desc(channel), ordinal], name)
        fused = fused.join(hits.select(key, name), key, "left")
    fused = fused.withColumn("rrf", rrf([F.col("v_rank"), F.col("b_rank"), F.col("f_rank")], rrf_k)).withColumn("vector_score", F.greatest("vector", "focus"))
    return fused.orderBy(F.desc("rrf"), ordinal).limit(k)


def focus_vectors(rows: DataFrame, text: Column, vector: str = "embedding") -> DataFrame:
    """Vectors, zero where there is no topical text. (RAG-08)"""
    return rows.withColumn(vector, F.when(F.coalesce(text, F.lit("")) == "", F.transform(vector, lambda x: x * 0)).otherwise(F.col(vector)))


def normalised(c: Column) -> Column:
    n = norm(c)
    return F.transform(c, lambda x: x.cast("double") / n)


def assess(retrieved: DataFrame, query: str, authoritative: bool = False, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(answerable, reason) for retrieved(name, vector_score), a row. (GOV-08)"""
    q = name_core(F.lit(query))
    core = name_core(F.col("name"))
    named = (core != "") & (((F.length(q) >= 4) & F.contains(core, q)) | ((F.length(core) >= 5) & F.contains(q, core)))
    one = retrieved.agg(F.count("*").alias("n"), F.max("vector_score").alias("best"), F.coalesce(F.bool_or(named), F.lit(False)).alias("named"))
    shown = F.format_string("%.2f", F.col("best"))
    status = (
        F.when(F.col("n") == 0, F.struct(F.lit(False).alias("answerable"), F.lit("no records matched the query").alias("reason")))
        .when(~F.col("named") & overrides_instructions(F.lit(query)), F.struct(F.lit(False).alias("answerable"), F.lit("out-of-scope request (instruction override) — queries are treated as questions about the records, never as instructions").alias("reason")))
        .when(F.col("named"), F.struct(F.lit(True).alias("answerable"), F.concat(F.lit("firm-name match (best similarity "), shown, F.lit(")")).alias("reason")))
        .when(F.lit(authoritative), F.struct(F.lit(True).alias("answerable"), F.lit("matched an authoritative metadata filter (state/country/type/AUM)").alias("reason")))
        .when(F.col("best") >= least, F.struct(F.lit(True).alias("answerable"), F.concat(F.lit("top similarity "), shown).alias("reason")))
        .otherwise(F.struct(F.lit(False).alias("answerable"), F.concat(F.lit("best match similarity "), shown, F.lit(f" is below the {least} threshold")).alias("reason"))))
    return one.select(status.alias("s")).select("s.*")


def ungrounded_names(answers: DataFrame, context: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with the firm-like names that context(name, text), a short list of records, does not have. (TXT-27)"""
    split = lambda c: F.filter(F.split(norm_name(c), " "), lambda t: (t != "") & ~t.isin(list(GENERIC)))
    own = context.agg(F.flatten(F.collect_set(F.array_union(split(F.col("name")), split(F.col("text"))))).alias("_known"), F.collect_set(norm_name(F.col("name"))).alias("_names"))
    pattern = r"\b([A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,4}\s+(?:Family Office|Family Offices|Capital|Advisors|Partners|Management|Group|LLC|LP))\b"
    named = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(pattern), F.lit(1))
    bad = F.filter(named, lambda m: (norm_name(m) != "") & ~F.array_contains("_names", norm_name(m)) & (F.size(split(m)) > 0) & ~F.arrays_overlap(split(m), F.col("_known")))
    return answers.join(F.broadcast(own)).withColumn("ungrounded", F.array_sort(F.array_distinct(bad))).drop("_known", "_names")  # own is one row


def extractive(cards: DataFrame) -> DataFrame:
    """One text that states each card's facts, and the cards cited, both in the order of place. (RAG-04)"""
    line = F.concat_ws(" ", F.concat(F.col("name"), F.lit(" ("), F.col("fo_type"), F.lit(")")), F.when(F.col("hq_country") != "", F.concat(F.lit("in"), F.lit(" "), F.concat_ws(", ", F.nullif("hq_city", F.lit("")), F.nullif("hq_state", F.lit("")), "hq_country"))), F.when(F.col("aum").isNotNull(), F.concat(F.lit("with "), F.col("aum"))))
    said = cards.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"), "fo_id"))).alias("_s"))  # as many as an answer shows
    return said.select(F.array_join(F.transform("_s", lambda x: F.concat(F.lit("- "), x.line)), "\n").alias("answer"), F.transform("_s", lambda x: x.fo_id).alias("citations"))


def dot_product(a: Column, b: Column) -> Column:
    return dot(a, b)
