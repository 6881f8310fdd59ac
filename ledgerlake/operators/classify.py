"""Firm types, fit scores, authority and change of trust (CLS, GOV, NUM-08, CYC-01 to CYC-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import confidence_score, release_band
from ..functions.text import generic_mailbox
from ..schemas import DISCOVERY_ONLY, MFO, SFO, SOURCE_CLASSES, TRUST_FIELDS, UNDETERMINED
from .filters import filled

# Patterns of firms that are something else, in order, each with the reason that is recorded.
REJECTS = (
    (r"\b(pension|retirement|401\s*k|403\s*b|profit\s*sharing|esop|benefit plan|welfare fund)\b", "employee benefit / pension plan"),
    (r"\b(insurance|assurance)\b", "insurance entity"),
    (r"\b(bancorp|bancshares|bankshares|savings bank|credit union)\b", "bank / depository"),
    (r"\b(university|college|school district|academy|seminary)\b", "educational institution"),
    (r"\b(church|diocese|archdiocese|ministries|ministry|synagogue|temple|congregation|parish|catholic|baptist|methodist|presbyterian|lutheran|episcopal|vincentian)\b", "religious organization"),
    (r"\b(hospital|health system|medical center|healthcare system)\b", "healthcare institution"),
    (r"\b(city of|county of|state of|municipal|water district|school board)\b", "government / municipal entity"),
    (r"\b(association|federation|society|league|network)\b", "membership / association / network, not a family office"),
)
PUBLIC, TRUSTEE = "public company (SEC tickers/exchanges present)", "individual trustee, not a family-office firm"
NO_EVIDENCE = "no affirmative family-office evidence from an authoritative source (name / discovery-only references are insufficient)"
EVIDENCE = ("SEC 13F filer self-identifying as a family office", "SEC Form ADV / IAPD registration names it a family office", "firm website describes itself as a family office")


def first_match(text: Column, cases, otherwise: Column | None = None) -> Column:
    """The value of the first pattern that a text matches. (CLS-01, CLS-02)"""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for pattern, value in reversed(cases):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def classify(firms: DataFrame) -> DataFrame:
    """firms(name, has_sec, is_public, website_text, iapd_name, iapd_other, extra) with qualifies, fo_type, evidence, confidence, reject_reason. (CLS-01)"""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, web = text("name"), text("website_text")
    registry = F.when(F.col("iapd_name").isNotNull(), F.lower(F.concat_ws(" ", "iapd_name", "iapd_other"))).otherwise(F.lit(""))
    everything = F.concat_ws(" ", name, web, registry, F.transform(F.coalesce("extra", F.array().cast("array<string>")), F.lower))
    office = lambda c: c.contains("family office")
    sources = F.array_compact(F.array(
        F.when(office(name) & F.coalesce("has_sec", F.lit(False)), EVIDENCE[0]), F.when(office(registry), EVIDENCE[1]), F.when(office(web), EVIDENCE[2])))
    rejected = F.when(F.coalesce("is_public", F.lit(False)), PUBLIC).otherwise(
        first_match(everything, REJECTS, F.when(name.rlike(r"\btrustee\b") & ~office(name), TRUSTEE).when(F.size(sources) == 0, NO_EVIDENCE)))
    multi, single = everything.rlike("(?i)multi[- ]?family (office|)"), everything.rlike("(?i)single[- ]?family office")
    kind = F.when(multi, MFO).when(single, SFO).otherwise(UNDETERMINED)
    basis = F.when(multi, "multi-family language").when(single, "single-family language").otherwise("single vs multi family not established")
    ok = F.col("reject_reason").isNull()
    return firms.withColumn("reject_reason", rejected).withColumn("qualifies", ok).withColumn("fo_type", F.when(ok, kind).otherwise(UNDETERMINED)).withColumn("evidence", F.when(ok, F.concat(F.array_join(sources, "; "), F.lit("; type: "), basis))).withColumn("confidence", F.when(~ok, "Low").when(F.size(sources) >= 2, "High").otherwise("Medium"))


def reclassified(records: DataFrame, rules: list[tuple[Column, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(records, audit rows): fo_type by the first rule (test, type, reason) that holds; changes go to the audit. (CLS-02, MNT-03)"""
    kind, why = F.col("fo_type"), F.lit("")
    for test, value, reason in reversed(rules):
        kind, why = F.when(test, value).otherwise(kind), F.when(test, reason).otherwise(why)
    both = records.withColumn("_new", kind).withColumn("_why", why)
    audit = both.where(~F.col("_new").eqNullSafe(F.col("fo_type"))).select("fo_id", F.lit("fo_type").alias("field"), F.col("fo_type").alias("rejected_value"), F.col("_why").alias("reason"))
    return both.withColumn("fo_type", F.col("_new")).drop("_new", "_why"), audit


def type_violations(records: DataFrame) -> DataFrame:
    """Records whose type contradicts their figures; none in a good release. (CLS-03)"""
    size = F.lower(F.coalesce("estimated_aum", F.lit("")))
    return records.where((F.col("fo_type") == SFO) & (size.contains("regulatory") | size.contains("adv")) | (F.col("fo_type").isin(SFO, MFO) & ~filled(F.col("fo_type_evidence"))))


def contact_route() -> Column:
    """The route to the named person: mailbox, then profile, then phone; never the firm's inbox. (CLS-05)"""
    route = lambda kind, why: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"), F.lit(why).alias("evidence"))
    mail = filled(F.col("principal_email")) & ~F.coalesce(F.col("principal_email_status") == "could_not_verify", F.lit(False))
    return (
        F.when(mail, route("principal_email", "named-person email, site/filing name-matched"))
        .when(filled(F.col("principal_linkedin")), route("principal_linkedin", "principal's own current LinkedIn profile"))
        .when(filled(F.col("principal_phone")), route("principal_phone", "authoritative filing (e.g. SEC 13F signature block)"))
    )


def sector_match(sectors: list[str]) -> Column:
    """Whether a record invests in, or speaks of, one of the sectors. (CLS-06)"""
    out = F.lit(False)
    for s in (x.lower() for x in sectors):
        own = F.array_contains(F.transform("investing_sectors", F.lower), s)
        out = out | F.coalesce(own, F.lit(False)) | F.coalesce(F.contains(F.lower("investment_thesis"), F.lit(s)), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), F.lit(s)), F.lit(False))
    return out


def place_match(places: list[str]) -> Column:
    """Whether a record's state or country is one of the places. (CLS-06)"""
    low = [p.lower() for p in places]
    return F.coalesce(F.lower("hq_state").isin(low), F.lit(False)) | F.coalesce(F.lower("hq_country").isin(low), F.lit(False)) if low else F.lit(False)


def fit(rows: DataFrame, sector_asked: bool, place_asked: bool, stale_days: int = 400) -> DataFrame:
    """rows(sector_match, geography_match, fo_type, fo_type_evidence, record_confidence, n_sources, n_signals, has_route, days, investment_thesis)
    with fit_score, reasons and uncertainty. (NUM-08, CLS-04)"""
    stale = F.coalesce(F.col("days") > stale_days, F.lit(False))
    evidence = filled(F.col("fo_type_evidence"))
    points = [
        F.when(F.col("sector_match"), 0.35).otherwise(0.0), F.when(F.col("geography_match"), 0.10).otherwise(0.0), F.when(evidence, 0.15).otherwise(0.0),
        F.when(F.col("record_confidence") == "High", 0.20).when(F.col("record_confidence") == "Medium", 0.10).otherwise(0.0),
        F.when(F.col("n_sources") >= 2, 0.10).when(F.col("n_sources") == 1, 0.03).otherwise(0.0), F.when(F.col("n_signals") > 0, 0.05).otherwise(0.0),
        F.when(F.col("has_route"), 0.05).otherwise(0.0), F.when(stale, -0.10).otherwise(0.0)]
    total = points[0]
    for p in points[1:]:
        total = total + p
    sector_ok = F.col("sector_match") | F.lit(not sector_asked)
    reasons = F.array_compact(F.array(
        F.when(~F.col("sector_match") & F.lit(sector_asked), "no stated sector/thesis match for the requested sector(s)"),
        F.when(~F.col("geography_match") & F.lit(place_asked), "headquarters not in the requested geography"),
        F.when(~evidence, "no affirmative family-office classification evidence on file"),
        F.when(F.col("n_sources") < 1, "zero independent verification sources on file"),
        F.when(~F.col("has_route"), "no named-person contact route (generic firm inbox does not count)"),
        F.when(stale, F.concat(F.lit("record data is "), F.col("days").cast("string"), F.lit(f" days old (>{stale_days}-day staleness bar)")))))
    ladder = (
        F.when((F.col("fo_type") == UNDETERMINED) & ~evidence, "insufficient").when(stale, "stale")
        .when((F.col("n_sources") == 0) & ~sector_ok, "insufficient")
        .when((F.col("n_sources") <= 1) | ~sector_ok | ~filled(F.col("investment_thesis")), "thin").otherwise("sufficient"))
    return rows.withColumn("fit_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)).withColumn("reasons", reasons).withColumn("uncertainty", ladder)


# What governance asks of a record and of a contact.
LEAST_SOURCES, LEAST_CONFIDENCE = 2, 0.85
VENDORS = ("vendor", "hunter.io", "apollo", "rocketreach", "contactout", "signalhire")


def authoritative_sources(sources: Column) -> Column:
    """How many sources may verify: known classes that are not for discovery only. (GOV-02)"""
    good = [c for c in SOURCE_CLASSES.values() if c not in DISCOVERY_ONLY]
    return F.coalesce(F.when(sources.isNotNull(), F.size(F.filter(sources, lambda s: s.source_class.isin(good)))), F.lit(0))


def govern(rows: DataFrame, label: str = "confidence", kind: str = "fo_type", evident: str = "evident", n_sources: str = "n_sources") -> DataFrame:
    """rows with score, action and reason: escalate what is undetermined, weak or short of sources, else approve. (GOV-01)"""
    rows = rows.withColumn("score", confidence_score(F.col(label)))
    vague = (F.col(kind) == UNDETERMINED) | ~F.coalesce(evident, F.lit(True))
    few, weak = F.col(n_sources) < LEAST_SOURCES, F.col("score") < LEAST_CONFIDENCE
    reasons = F.concat_ws("; ",
        F.when(few, F.concat(F.lit("insufficient independent sources ("), F.col(n_sources).cast("string"), F.lit(" authoritative; minimum 2)"))),
        F.when(vague, "undetermined or no affirmative evidence"), F.when(weak, "low confidence"))
    held = F.coalesce(vague, F.lit(False)) | few | weak
    return rows.withColumn("action", F.when(held, "escalate").otherwise("approve")).withColumn("reason", F.when(held, reasons).otherwise("approved by policy"))


def review_contact(person: Column, email: Column, email_type: Column, source_type: Column, confidence: Column) -> Column:
    """Status of a contact: refuse, escalate or autonomous. (GOV-03)"""
    return (
        F.when(~filled(F.trim(person)) | generic_mailbox(email) | (email_type != "corporate"), "refuse")
        .when(source_type.isin(*VENDORS), "escalate").when(confidence >= 0.90, "autonomous").when(confidence >= 0.70, "escalate").otherwise("refuse")
    )


def may_publish(confidence: Column, n_sources: Column) -> Column:
    """Status of a record; confidences in a gap between the bands are refused. (GOV-04)"""
    band = release_band(confidence)
    return (
        F.when(n_sources < LEAST_SOURCES, "refuse").when(confidence < LEAST_CONFIDENCE, "escalate").when(band.isin("auto_release", "auto_release_medium"), "autonomous")
        .when(band == "hold_governance_review", "escalate").otherwise("refuse")
    )


def authority_tier(action: Column, never: list[str], granted: dict[str, str]) -> Column:
    """Tier of an action: banned words refuse, granted actions pass, all else is escalated. (GOV-05)"""
    banned = F.exists(F.array(*[F.lit(n) for n in never]), lambda n: action.contains(n)) if never else F.lit(False)
    alone = [a for a, s in granted.items() if s == "autonomous"]
    return F.when(banned, 3).when(action.isin(alone) if alone else F.lit(False), 1).otherwise(2)


def trust_snapshot(records: DataFrame) -> DataFrame:
    """The fields that trust depends on, and the number of sources. (CYC-01)"""
    n = F.coalesce(F.when(F.col("verification_sources").isNotNull(), F.size("verification_sources")), F.lit(0)).alias("n_sources")
    return records.where(filled(F.col("fo_id"))).select("fo_id", *TRUST_FIELDS, n)


def trust_reason(fewer: Column) -> Column:
    """The weightiest reason for changed, an array of (field, was, now); fewer says that the number of sources fell. (CYC-02)"""
    has = lambda *names: F.exists("changed", lambda c: c.field.isin(*names))
    return (
        F.when(fewer, "a source that previously corroborated this record no longer does (verification-source count dropped)")
        .when(has("fo_type", "fo_type_evidence"), "classification/evidence changed on re-verification between cycles")
        .when(has("record_confidence"), "record confidence changed on re-verification between cycles")
        .when(has("principal_email", "principal_linkedin", "principal_phone", "firm_contact_email"), "a contact field changed or disappeared between cycles")
        .otherwise("a trust-bearing field changed on re-verification between cycles"))


def trust_changes(prior: DataFrame, current: DataFrame, fields: tuple[str, ...] = (*TRUST_FIELDS, "n_sources"), key: str = "fo_id") -> DataFrame:
    """Rows of both snapshots whose fields differ: changed (field, was, now) and the weightiest reason. (CYC-02, JOIN-10)"""
    both = prior.alias("p").join(current.alias("c"), key)
    change = lambda f: F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"p.{f}").cast("string").alias("was"), F.col(f"c.{f}").cast("string").alias("now")))
    rows = both.select(key, F.array_compact(F.array(*[change(f) for f in fields])).alias("changed"), *([(F.col("c.n_sources") < F.col("p.n_sources")).alias("_fewer")] if "n_sources" in fields else [F.lit(False).alias("_fewer")]))
    return rows.where(F.size("changed") > 0).select(key, trust_reason(F.col("_fewer")).alias("reason"), "changed")
