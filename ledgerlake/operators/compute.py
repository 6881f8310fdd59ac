"""Scoped, recomputable aggregates (AGG). Each is one pass over the rows and says what it covers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio
from ..schemas import MEASURE_TYPES


class ComputeError(ValueError):
    """An aggregate that has no defined answer."""


class MixedMeasureError(ComputeError):
    """A total over more than one type of measure."""


def scoped_count(rows: DataFrame, condition: Column) -> DataFrame:
    """value, total_records, searched, qualified, included_in_calc; what is included is what was searched. (AGG-01)"""
    n, hit = F.count("*"), F.count_if(condition)
    return rows.agg(hit.alias("value"), n.alias("total_records"), n.alias("searched"), hit.alias("qualified"), F.lit(None).cast("long").alias("carried_measure"), n.alias("included_in_calc"))


def totals_by_type(measures: DataFrame, amount: str = "amount", kind: str = "measure_type") -> DataFrame:
    """A total for each type of measure. (AGG-02)"""
    exact = F.sum(F.col(amount).cast("decimal(38,2)"))
    return measures.groupBy(F.col(kind).alias("measure_type")).agg(exact.cast("double").alias("total"), F.count("*").alias("n_included"))


def typed_total(rows: DataFrame, measures: DataFrame, condition: Column, measure_type: str | None = None, key: str = "fo_id", types: Iterable[str] = MEASURE_TYPES) -> DataFrame:
    """One row: value, measure_type and scope of the total of one type over the qualified rows' measures. (AGG-02)

    An unknown type is refused; so are several types if none is named. The sums by type are what reaches the driver.
    """
    if measure_type is not None and measure_type not in set(types):
        raise ComputeError(f"unknown measure type {measure_type!r}; valid are {sorted(types)}")
    qualified = rows.where(condition)
    carried = qualified.select(key).join(measures, key)
    found = {r["measure_type"]: r for r in totals_by_type(carried).collect()}  # as many rows as types
    if measure_type is None and len(found) > 1:
        raise MixedMeasureError(f"a total over {sorted(found)} needs a measure type")
    measure_type = measure_type or next(iter(found), "unknown")
    mine = found.get(measure_type)
    counts = rows.agg(F.count("*").alias("total_records"), F.count_if(condition).alias("qualified"))
    return counts.select(
        F.lit(float(mine["total"]) if mine else 0.0).alias("value"), F.lit(measure_type).alias("measure_type"), "total_records", F.col("total_records").alias("searched"), "qualified",
        F.lit(sum(r["n_included"] for r in found.values())).cast("long").alias("carried_measure"), F.lit(mine["n_included"] if mine else 0).cast("long").alias("included_in_calc"))


def distribution(rows: DataFrame, column: str, condition: Column | None = None, ordinal: str | None = None) -> DataFrame:
    """key, n, in the order of falling n and first appearance; null and empty are "(blank)". (AGG-03)"""
    rows = rows if condition is None else rows.where(condition)
    key = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(blank)"))
    counted = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(ordinal or F.lit(0)).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", "key").drop("_first")


def route_coverage(rows: DataFrame, route: Column, status: Column | None = None, good=("deliverable", "approved", "verified")) -> DataFrame:
    """with_route, verified_route and scope. (AGG-04)"""
    trimmed = F.trim(route.cast("string"))
    has = F.coalesce((trimmed != "") & ~trimmed.isin("NA", "could_not_verify"), F.lit(False))
    verified = has & F.coalesce(status.cast("string").isin(*good), F.lit(False)) if status is not None else F.lit(False)
    return rows.agg(F.count_if(has).alias("with_route"), F.count_if(verified).alias("verified_route"), F.count("*").alias("total_records"))


def route_rows(rows: DataFrame, key: str, route: Column, status: Column, good=("deliverable", "approved", "verified")) -> DataFrame:
    """The trace of route_coverage(): a row each. (AGG-04)"""
    trimmed = F.trim(route.cast("string"))
    has = F.coalesce((trimmed != "") & ~trimmed.isin("NA", "could_not_verify"), F.lit(False))
    return rows.select(key, has.alias("has_route"), F.coalesce(status, F.lit("")).alias("status"), (has & F.coalesce(status.isin(*good), F.lit(False))).alias("verified"))


def freshness(rows: DataFrame, column: str = "data_as_of") -> DataFrame:
    """Rows by date; null is the text None. (AGG-05)"""
    text = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    return rows.groupBy(F.when(text == "", "(none)").otherwise(text).alias("key")).agg(F.count("*").alias("n"))


def decompose(parts: dict[str, DataFrame]) -> DataFrame:
    """Several answers as (part, value); none is dropped. (AGG-06)"""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def field_coverage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """How many rows have each of the named properties, and how many rows there are. (AGG-07, AGG-09)"""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in columns.items()])


def served_stats(records: DataFrame) -> DataFrame:
    """Counts of evidence, reachability and coverage over nested records, one row. (AGG-09)"""
    full = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    n_sources = F.size("verification_sources")
    named, firm = full("principal_email") | full("principal_phone") | full("principal_linkedin"), full("firm_contact_email") | full("hq_phone")
    coverages = ("website", "hq_phone", "principal_name", "principal_email", "firm_contact_email", "estimated_aum", "investment_thesis")
    return records.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("fo_type") == t).alias(n) for n, t in (("single", "Single-Family Office"), ("multi", "Multi-Family Office"), ("undetermined", "Undetermined"))],
        *[F.count_if(F.col("record_confidence") == c).alias(c.lower()) for c in ("High", "Medium", "Low")],
        F.count_if(n_sources >= 2).alias("two_sources"), F.count_if(n_sources == 1).alias("one_source"), F.count_if(n_sources <= 0).alias("no_source"),
        F.count_if(named & firm).alias("named_and_firm"), F.count_if(named & ~firm).alias("named_only"), F.count_if(~named & firm).alias("firm_only"), F.count_if(~named & ~firm).alias("unreachable"),
        *[F.count_if(full(c)).alias(f"has_{c}") for c in coverages],
        F.count_distinct(F.nullif("hq_country", F.lit(""))).alias("countries"), F.max("data_as_of").alias("as_of"))


def confusion(rows: DataFrame, truth: Column, predicted: Column, type_ok: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn and rates to four places, 0 without a denominator. (AGG-13)"""
    cells = rows.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(~truth & ~predicted).alias("tn"), F.count_if(truth & ~predicted).alias("fn"), *([] if type_ok is None else [F.round(F.avg(type_ok.cast("double")), 4).alias("type_accuracy")]))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cells.select("*", precision.alias("precision"), recall.alias("recall"), ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def evaluate_labels(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """confusion() of labels(firm_name, is_family_office, true_type) against the last prediction of each name. (AGG-13, JOIN-03)"""
    last = predictions.groupBy("firm_name").agg(F.max_by(F.struct("qualifies", "fo_type"), "ordinal").alias("p"))
    met = labels.join(last, "firm_name")
    typed = F.when(F.col("is_family_office") & F.col("p.qualifies") & F.col("true_type").isNotNull(), F.col("p.fo_type") == F.col("true_type"))
    return confusion(met, F.col("is_family_office"), F.col("p.qualifies"), typed)


def funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(place, step, n, pct): how many rows pass each step and all before it, in percent of the first. (AGG-14, AGG-18)"""
    passed, aggs = F.lit(True), []
    for i, (_, c) in enumerate(steps):
        passed = passed & F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"s{i}"))
    one = rows.agg(*aggs)
    first = F.col("s0")
    entries = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n"), ratio(F.col(f"s{i}"), first, 1, 100.0).alias("pct")) for i, (name, _) in enumerate(steps)]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def failures(outcomes: DataFrame) -> DataFrame:
    """How often each gate fails and why: outcomes(checks array of (name, passed, detail)). (AGG-14, AGG-18)"""
    failed = outcomes.select(F.explode("checks").alias("c")).where("NOT c.passed")
    return failed.groupBy(F.concat_ws(": ", "c.name", "c.detail").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def exploded_counts(rows: DataFrame, values: Column, top: int | None = None) -> DataFrame:
    """Counts over the elements of an array, each once a row; the top most frequent. (AGG-15, AGG-16, SRT-09)"""
    out = rows.select(F.explode(F.array_distinct(values)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")
    return out if top is None else out.limit(top)


def yield_by(rows: DataFrame, source: str, qualified: Column, reason: str | None = None) -> DataFrame:
    """found, qualified and rejected by source. (AGG-16, AGG-17)"""
    out = rows.groupBy(source).agg(F.count("*").alias("found"), F.count_if(qualified).alias("qualified"), F.count_if(~qualified).alias("rejected"))
    if reason is None:
        return out
    reasons = rows.where(~qualified).groupBy(source, reason).agg(F.count("*").alias("n")).groupBy(source).agg(F.max_by(reason, F.struct("n", reason)).alias("main_reason"))
    return out.join(reasons, source, "left")


def rates(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Percentages of rows with each property, to one place. (AGG-19)"""
    return rows.agg(*[ratio(F.count_if(c), F.count("*"), 1, 100.0).alias(name) for name, c in parts.items()])


def first_category(rows: DataFrame, cases: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Rows by the first of the cases that holds. (AGG-20)"""
    c = F.lit(otherwise)
    for name, test in reversed(cases):
        c = F.when(test, name).otherwise(c)
    return rows.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


def share_of_most(rows: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The top values with their share of the largest. (AGG-28)"""
    counted = rows.where(F.coalesce(F.col(column).cast("string") != "", F.lit(False))).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return counted.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 4))


def accuracy_by(rows: DataFrame, group: str, correct: Column) -> DataFrame:
    """Accuracy by group. (AGG-27)"""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 4).alias("accuracy"))


def uncertainty_counts(fitted: DataFrame) -> DataFrame:
    """Rows of fit() by group: sufficient, thin or stale as thin, insufficient. (AGG-24)"""
    group = F.when(F.col("uncertainty").isin("thin", "stale"), "thin").otherwise(F.col("uncertainty"))
    return fitted.groupBy(group.alias("uncertainty_group")).agg(F.count("*").alias("n"))


def people_totals(pages: DataFrame) -> DataFrame:
    """One row over pages(firm, people): firms, firms with a page, people, verdicts, mailboxes and profiles. (AGG-30)"""
    p = pages.select("firm", F.col("people").isNotNull().alias("page"), F.explode_outer("people").alias("p"))
    return p.agg(
        F.count_distinct("firm").alias("sample_size"), F.count_distinct(F.when(F.col("page"), F.col("firm"))).alias("team_pages_found"), F.count("p").alias("people_extracted"),
        F.count_if(F.col("p.verdict") == "verified_decision_maker").alias("verified"), F.count_if(F.col("p.verdict") == "possible_decision_maker").alias("possible"),
        F.count_if(F.coalesce(F.col("p.email") != "", F.lit(False))).alias("emails"), F.count_if(F.coalesce(F.col("p.linkedin") != "", F.lit(False))).alias("profiles"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status. (AGG-25)"""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the size of each channel. (AGG-26, CYC-10)"""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
