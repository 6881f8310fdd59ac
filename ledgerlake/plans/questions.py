"""Questions as a table: all of them read in one projection and answered from one pass over the records (FLT-03, FLT-04, RAG-03, AGG-07, AGG-08).

What a question means is what answer.plan() says of it, one by one; here the rules are Columns, so a table of any length is read where
it lies. Counts and totals come from the records grouped by type, state and country, which meet the questions by those keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import parse_aum
from ..operators import filters as P
from .answer import MEASURES, SUBJECTS

KEYS = ("fo_type", "hq_state", "hq_country")


def _table(pairs: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def _least(text: Column, names: list[str], between: str, rank: dict[str, int]) -> Column:
    """The least rank of the names that stand in text; null if there is none. Names are sought at every place, so one within another counts too."""
    ordered = sorted(names, key=len, reverse=True)
    pattern = r"(?=\b(" + "|".join(re.escape(n).replace(r"\ ", between) for n in ordered) + r")\b)"
    met = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_min(F.transform(met, lambda m: F.try_element_at(_table(rank), F.regexp_replace(m, "[ -]", ""))))


def _state(text: Column) -> Column:
    """A state by its full name, in the order of the list, else by the first abbreviation; those that are words count in capitals, and not if the whole question is."""
    rank = {n.replace(" ", ""): i for i, n in enumerate(P.STATES)}
    full = _least(F.lower(text), list(P.STATES), "[ -]?", rank)
    by_rank = F.array(*[F.lit(c) for c in P.STATES.values()])
    plain = "|".join(c for c in P.STATES.values() if c not in P.WORDS_TOO)
    capitals = "|".join(sorted(P.WORDS_TOO))
    shouted = (text == F.upper(text)) & (text != F.lower(text))
    first = lambda pattern: F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(""))
    short = F.when(shouted, first(rf"\b((?i:{plain}))\b")).otherwise(first(rf"\b((?i:{plain})|{capitals})\b"))
    return F.coalesce(F.get(by_rank, full), short)


def _country(text: Column) -> Column:
    rank = {n.replace(" ", ""): i for i, n in enumerate(P.COUNTRIES)}
    return F.get(F.array(*[F.lit(c) for c in P.COUNTRIES.values()]), _least(F.lower(text), list(P.COUNTRIES), " ", rank))


def _bounds(text: Column) -> Column:
    """The first threshold with a number, as (up_to, amount); null if there is none."""
    pattern = F.lit(rf"(?i)(?:({P.FROM_ON})|(?:{P.UP_TO}))\s*\$?\s*([\d.,]+)\s*(billion|million|thousand|b|m|k)\b")
    from_on, number, unit = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3))
    parsed = F.transform(F.arrays_zip(from_on.alias("f"), number.alias("n"), unit.alias("u")), lambda m: F.struct(
        (m["f"] == "").alias("up_to"), F.when(F.replace(m["n"], F.lit(","), F.lit("")).rlike(r"^(\d+\.?\d*|\.\d+)$"), F.replace(m["n"], F.lit(","), F.lit("")).try_cast("double") * F.element_at(_table(P.UNITS), F.lower(m["u"]))).cast("long").alias("amount")))
    return F.get(F.filter(parsed, lambda m: m.amount.isNotNull()), 0)


def _first(text: Column, rules) -> Column:
    """The name of the first pattern that text has."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def read(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with mode (universal, count, total, both or retrieve), subject, measure and the conditions that each names.

    A null text is an empty question, which retrieves. Other columns stay, but for those of these names, which are replaced.
    """
    q = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(q)
    ours = low.rlike(P.DOMAIN_TERM)
    subject = F.when(low.rlike(P.UNIVERSAL) & low.rlike(P.HAS) & ours, _first(low, [(k, f"(?i){p}") for k, p, _ in SUBJECTS]))
    measure = _first(low, [(m, p) for p, m in MEASURES])
    total = low.rlike(P.TOTAL_INTENT) & ~low.rlike("total number of") & measure.isNotNull()
    count = low.rlike(P.COUNT_INTENT) & ours
    mode = F.when(subject.isNotNull(), "universal").when(total & count, "both").when(total, "total").when(count, "count").otherwise("retrieve")
    kind = F.when(q.rlike(f"(?i){P.SINGLE}"), "Single-Family Office").when(q.rlike(f"(?i){P.MULTI}"), "Multi-Family Office")
    bound, at = _bounds(q), lambda name: F.when(F.col("mode") != "universal", F.col(name)).alias(name)
    own = {"mode": mode, "subject": subject, "measure": F.when(total & subject.isNull(), measure), "fo_type": kind, "hq_state": _state(q), "hq_country": _country(q), "_bound": bound}
    rows = questions.select(*[c for c in questions.columns if c not in own and c not in ("aum_min", "aum_max")], *[c.alias(n) for n, c in own.items()])
    sizes = [F.when((F.col("mode") == "retrieve") & (F.col("_bound.up_to") == up_to), F.col("_bound.amount")).alias(n) for n, up_to in (("aum_min", False), ("aum_max", True))]
    kept = [c for c in rows.columns if c not in ("_bound", *KEYS)]
    return rows.select(*kept, at("fo_type"), at("hq_state"), F.when((F.col("mode") != "universal") & F.col("hq_state").isNull(), F.col("hq_country")).alias("hq_country"), *sizes)


def _cube(records: DataFrame) -> DataFrame:
    """Counts, and totals by type of measure, of records for each choice of KEYS to be asked for; _asked has a bit for each key that is left open.

    Records are grouped by all keys first, so what is grouped again in every way is as long as there are different keys.
    """
    m = parse_aum(F.col("estimated_aum"))
    rows = records.select(*[F.col(k).cast("string").alias(k) for k in KEYS], m.alias("m")).select(*KEYS, F.col("m.measure_type").alias("_kind"), F.col("m.amount").cast("decimal(38,2)").alias("_amount"))
    small = rows.groupBy(*KEYS, "_kind").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_sum"))
    sets = [[k for i, k in enumerate(KEYS) if not left >> (len(KEYS) - 1 - i) & 1] for left in range(2 ** len(KEYS))]
    ways = small.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in KEYS])
    kinds = [k for _, k in MEASURES]
    per_kind = [x for k in kinds for x in (F.sum(F.when(F.col("_kind") == k, F.col("_sum"))).alias(f"sum_{k}"), F.sum(F.when(F.col("_kind") == k, F.col("_n"))).alias(f"n_{k}"))]
    return ways.agg(F.grouping_id().cast("int").alias("_asked"), F.sum("_n").alias("_qualified"), *per_kind)


def answers(records: DataFrame, questions: DataFrame, key: str = "question_id", text: str = "text") -> DataFrame:
    """(key, mode, ..., qualified, total_records, included, total, have_field): what answer.aggregate() gives for each question, in one row.

    qualified is of counts and totals, included and total of totals, have_field of claims about all firms; questions that
    retrieve have none of them. A condition that no record meets counts 0, and so does every question of no records.
    """
    read_ = read(questions, text).withColumnRenamed(key, "_key")
    open_keys = sum((F.col(k).isNull().cast("int") * 2 ** (len(KEYS) - 1 - i) for i, k in enumerate(KEYS)), F.lit(0))
    cube = _cube(records).withColumnsRenamed({k: f"_{k}" for k in KEYS})
    has = {name: F.col("estimated_aum").rlike(r"(?i)13f|13\(f\)|securit") if name == "13f" else P.filled(F.trim(F.col(name))) for name, _, _ in SUBJECTS}
    whole = records.agg(F.count("*").alias("total_records"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"have_{n}") for n, c in has.items()])
    met = [F.col("_open") == F.col("_asked"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]]
    rows = read_.withColumn("_open", open_keys).join(cube, met, "left").join(F.broadcast(whole))  # whole is one row
    pick = lambda prefix, c, names: F.coalesce(*[F.when(c == n, F.col(f"{prefix}{n}")) for n in names])
    kinds, named, totals = [k for _, k in MEASURES], F.col("subject"), F.col("mode").isin("total", "both")
    zero = F.lit(0).cast("long")
    return rows.select(
        F.col("_key").alias(key), "mode", "subject", "measure", *KEYS, "aum_min", "aum_max",
        F.when(F.col("mode").isin("count", "total", "both"), F.coalesce("_qualified", zero)).alias("qualified"), F.when(F.col("mode") != "retrieve", F.col("total_records")).alias("total_records"),
        F.when(totals, F.coalesce(pick("n_", F.col("measure"), kinds), zero)).alias("included"), F.when(totals, F.coalesce(pick("sum_", F.col("measure"), kinds).cast("double"), F.lit(0.0))).alias("total"),
        F.when(named.isNotNull(), pick("have_", named, list(has))).alias("have_field"))
