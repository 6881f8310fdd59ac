"""Release gates, completeness and coverage (GAT, AGG-10 to AGG-12) as boolean columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio
from ..schemas import DISCOVERY_ONLY, INTELLIGENCE_FIELDS, MFO, REQUIRED_FIELDS, SFO
from .filters import filled
from .records import delivery, independence_warnings, is_verified, provenance_violations

def _check(name: str, passed: Column, good: Column | str, bad: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.when(passed, lit(good)).otherwise(lit(bad)).alias("detail"))


def leaked(records: DataFrame, audit: DataFrame) -> DataFrame:
    """(fo_id, leaked): rejected values that stand in a delivered cell. (GAT-09)"""
    cells = delivery(records)
    values = cells.select("fo_id", F.explode(F.array_distinct(F.array(*[F.col(c) for c in cells.columns if c != "fo_id"], F.col("fo_id")))).alias("value")).where("value <> ''")
    met = values.join(audit.select("fo_id", F.col("rejected_value").alias("value")).where("value <> ''").distinct(), ["fo_id", "value"])
    return met.groupBy("fo_id").agg(F.array_sort(F.collect_set("value")).alias("leaked"))


def evaluate(records: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """records with checks (name, passed, detail) of the nine gates and passed. (GAT-01 to GAT-09)"""
    if audit is not None:
        records = records.join(leaked(records, audit), "fo_id", "left")
    else:
        records = records.withColumn("leaked", F.lit(None).cast("array<string>"))
    evidence, typed = filled(F.col("fo_type_evidence")), F.col("fo_type").isin(SFO, MFO)
    authoritative = F.size(F.filter("verification_sources", lambda s: ~s.source_class.isin(*DISCOVERY_ONLY)))
    authoritative = F.when(F.col("verification_sources").isNull(), 0).otherwise(authoritative)
    misused = F.coalesce(F.filter(F.transform("verification_sources", lambda s: s.source_class), lambda c: c.isin(*DISCOVERY_ONLY)), F.array().cast("array<string>"))
    warnings, violations = independence_warnings(), provenance_violations()
    any_of = lambda *cs: F.coalesce(F.greatest(*[filled(F.col(c)).cast("int") for c in cs]) == 1, F.lit(False))
    place = any_of("hq_country", "hq_state", "hq_city")
    useful = any_of("principal_email", "principal_phone", "principal_linkedin", "hq_phone", "website", "investment_thesis") | (F.coalesce(F.size("signals"), F.lit(0)) > 0)
    missing = F.array_compact(F.array(F.when(~filled(F.col("name")), "name"), F.when(~place, "geography"), F.when(~useful, "actionable_or_entity_intelligence")))
    lost = F.coalesce("leaked", F.array().cast("array<string>"))
    checks = F.array(
        _check("family_office_evidenced", evidence, "affirmative FO evidence present", "no affirmative FO evidence (fo_type_evidence missing)"),
        _check("classification_evidence", ~typed | evidence, "typed FO carries evidence", F.concat(F.lit("typed "), F.col("fo_type"), F.lit(" without classification evidence"))),
        _check("discovery_documented", F.col("discovery_source").isNotNull(), F.col("discovery_source"), "missing"),
        _check("verification_documented", authoritative >= 1, F.concat(authoritative.cast("string"), F.lit(" authoritative verification source(s)")), "0 authoritative verification source(s)"),
        _check("verification_authoritative", F.size(misused) == 0, "ok", F.concat(F.lit("discovery-only source used to verify: "), F.array_join(misused, ", "))),
        _check("no_contradictions", F.size(warnings) == 0, "none", F.array_join(warnings, "; ")),
        _check("mandatory_fields_complete", F.size(missing) == 0, "complete", F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        _check("provenance_complete", F.size(violations) == 0, "complete", F.array_join(F.transform(violations, lambda v: F.concat(v.field, F.lit(":"), v.reason)), "; ")),
        _check("no_rejected_values_shipped", F.size(lost) == 0, "ok", F.concat(F.lit("rejected value in delivered field: "), F.array_join(lost, ", "))),
    )
    return records.withColumn("checks", checks).withColumn("passed", F.forall("checks", lambda c: c["passed"])).drop("leaked")


def publish(records: DataFrame, audit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(released records, outcomes of all). (GAT-10)"""
    judged = evaluate(records, audit)
    return judged.where("passed").drop("checks", "passed"), judged.select("fo_id", "passed", "checks")


def _populated(name: str) -> Column:
    if name == "geography":
        return filled(F.col("hq_country")) | filled(F.col("hq_state")) | filled(F.col("hq_city"))
    if name == "verification_source":
        return F.coalesce(F.exists("verification_sources", lambda s: ~s.source_class.isin(*DISCOVERY_ONLY)), F.lit(False))
    if name == "signals":
        return F.coalesce(F.size("signals") > 0, F.lit(False))
    return filled(F.col(name))


def _verified(name: str) -> Column:
    if name == "geography":
        return is_verified("hq_country") | is_verified("hq_state") | is_verified("hq_city")
    return _populated(name) if name == "verification_source" else is_verified(name)


def completeness(records: DataFrame, as_of: str, audit: DataFrame | None = None) -> DataFrame:
    """Which fields each record fills, proves and lacks, and whether it may be released. (AGG-10)

    provenance_coverage counts provenance of any filled column over the filled fields of this list, and so may be over 1.
    """
    names = (*REQUIRED_FIELDS, *INTELLIGENCE_FIELDS)
    pick = lambda test: F.array_sort(F.array_compact(F.array(*[F.when(test(n), F.lit(n)) for n in names])))
    plain = [f.name for f in records.schema.fields if f.dataType.simpleString() == "string"]
    used = F.array_compact(F.array(*[F.when(filled(F.col(c)), F.lit(c)) for c in plain], *[F.when(F.size(c) > 0, F.lit(c)) for c in ("signals", "investing_sectors")]))
    judged = evaluate(records, audit)
    out = judged.select(
        "fo_id", "name", pick(_populated).alias("populated_fields"), pick(lambda n: _populated(n) & _verified(n)).alias("verified_fields"),
        pick(lambda n: ~_populated(n) if n in REQUIRED_FIELDS else F.lit(False)).alias("missing_fields"), pick(lambda n: _populated(n) & ~_verified(n)).alias("unverified_fields"),
        F.size(F.array_intersect(F.map_keys("provenance"), used)).alias("_proved"), F.col("fo_type").alias("classification_status"),
        (filled(F.col("fo_type_evidence")) | (F.col("fo_type") == "Undetermined")).alias("classification_evidenced"), "passed",
        F.col("record_confidence").alias("confidence"), F.date_diff(F.lit(as_of).cast("date"), "data_as_of").alias("freshness_days"))
    intelligence = F.size(F.array_intersect("verified_fields", F.array(*[F.lit(n) for n in INTELLIGENCE_FIELDS]))) > 0
    return out.select(
        "*", ratio(F.col("_proved"), F.size("populated_fields"), 3).alias("provenance_coverage"), (F.size("missing_fields") == 0).alias("required_fields_complete"),
        ((F.size("missing_fields") == 0) & (F.size("verified_fields") >= len(REQUIRED_FIELDS)) & intelligence).alias("fully_enriched"),
        F.when(F.col("passed"), "releasable").otherwise("blocked").alias("release_status")).drop("_proved", "passed")


def coverage(records: DataFrame, as_of: str, audit: DataFrame | None = None) -> DataFrame:
    """Thirteen measures of a whole dataset, zeros if it is empty. (AGG-11)"""
    share = lambda c: ratio(F.count_if(c), F.count("*"), 3)
    proved = F.col("principal_email").isNotNull() & F.coalesce(F.col("principal_email_status").isin("deliverable", "approved", "verified"), F.lit(False))
    contact = (filled(F.col("principal_email")) & proved) | (filled(F.col("principal_phone")) & is_verified("principal_phone")) | ((filled(F.col("principal_linkedin")) | filled(F.col("corporate_linkedin"))) & (is_verified("principal_linkedin") | is_verified("corporate_linkedin")))
    per_record = records.agg(F.count("*").alias("total_records"), share(_populated("verification_source")).alias("evidence_coverage"), share(filled(F.col("principal_name"))).alias("named_person_coverage"), share(filled(F.col("estimated_aum"))).alias("aum_coverage"), share(filled(F.col("website"))).alias("website_coverage"), share(contact).alias("verified_contact_coverage"))
    c = completeness(records, as_of, audit)
    per_outcome = c.agg(
        F.count_if(F.col("release_status") == "releasable").alias("released_records"), share(F.col("required_fields_complete")).alias("required_field_completion_rate"), F.count_if("fully_enriched").alias("fully_enriched"),
        F.coalesce(F.sum(F.size("verified_fields")), F.lit(0)).alias("verified_fields_total"), F.coalesce(F.sum(F.size("unverified_fields") + F.size("missing_fields")), F.lit(0)).alias("unresolved_field_cells"))
    return per_record.join(F.broadcast(per_outcome))  # one row each


def gate_passing_count(records: DataFrame, ordinal: str | None = None) -> DataFrame:
    """How many records pass all gates, the last of each id. (AGG-12)"""
    if ordinal:
        others = [c for c in records.columns if c != "fo_id"]
        records = records.groupBy("fo_id").agg(F.max_by(F.struct(*others), ordinal).alias("r")).select("fo_id", "r.*")
    return evaluate(records).agg(F.count_if("passed").alias("gate_passing"))
