"""Nested entity records: delivery rows, lineage and the rules of proof (PRJ, ARR, JSN, AGG-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import parse_aum_usd
from ..schemas import CONFIDENCE_FIELDS, HIGH_VALUE_FIELDS, MFO, RECORD, SFO, SOURCE_CLASSES
from .filters import filled


def confidence_rank(c: Column) -> Column:
    return F.when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1)


def confidence_label(rank: Column) -> Column:
    return F.when(rank == 3, "High").when(rank == 2, "Medium").when(rank == 1, "Low")


def field_confidence(name: str) -> Column:
    """A field's confidence from its evidence; null without. (AGG-23)"""
    if name == "fo_type":
        return F.col("fo_type_confidence")
    if name == "recent_activity":
        return confidence_label(F.array_min(F.transform("signals", lambda s: confidence_rank(s.confidence))))
    return F.try_element_at("provenance", F.lit(name)).confidence


def record_confidence() -> Column:
    """The weakest of the name's and the type's confidence. (AGG-23)"""
    ranks = F.array_compact(F.array(confidence_rank(field_confidence("name")), confidence_rank(F.col("fo_type_confidence"))))
    return F.coalesce(confidence_label(F.array_min(ranks)), F.lit("Low"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def delivery(records: DataFrame, max_signals: int = 3) -> DataFrame:
    """The flat row that customers get: 49 columns of text, nothing is null. (PRJ-01, ARR-01)"""
    signal = lambda i: F.get("signals", F.lit(i))
    plain = [c for c in ("description", "investment_thesis")], [c for c in ("estimated_aum", "website", "corporate_linkedin", "hq_city", "hq_state", "hq_country", "hq_phone", "principal_name", "principal_title", "principal_linkedin", "principal_email", "principal_email_status", "principal_phone", "firm_contact_email", "firm_contact_email_status")]
    out = [F.col("fo_id"), F.col("name").alias("family_office_name"), F.col("fo_type"), _text("fo_type_evidence").alias("classification_evidence")]
    out += [_text(c).alias(c) for c in plain[0]]
    out.append(F.coalesce(F.array_join("investing_sectors", "; "), F.lit("")).alias("investing_sectors"))
    out += [_text(c).alias(c) for c in plain[1]]
    for i in range(max_signals):
        s, n = signal(i), f"recent_signal_{i + 1}"
        out += [F.coalesce(s.text, F.lit("")).alias(n), F.coalesce(s.event_date.cast("string"), F.lit("")).alias(f"{n}_date"), F.coalesce(s.source_url, F.lit("")).alias(f"{n}_source")]
    out += [F.coalesce(field_confidence(c), F.lit("")).alias(f"{c}_confidence") for c in CONFIDENCE_FIELDS]
    verified = F.transform("verification_sources", lambda s: F.concat(s.source_class, F.lit(" ("), s.verifies, F.lit(")")))
    out += [F.col("discovery_source"), F.coalesce(F.array_join(verified, "; "), F.lit("")).alias("verification_sources"), F.col("record_confidence"), F.col("data_as_of").cast("string").alias("data_as_of"), F.coalesce(F.array_join("could_not_verify", "; "), F.lit("")).alias("could_not_verify"), _text("reviewer_notes").alias("reviewer_notes")]
    return records.select(*out)


def metadata(records: DataFrame) -> DataFrame:
    """What retrieval filters on. (PRJ-02)"""
    return records.select("fo_id", "fo_type", F.upper(_text("hq_state")).alias("hq_state"), _text("hq_country").alias("hq_country"), F.col("record_confidence").alias("confidence"), F.transform("investing_sectors", F.lower).alias("sectors"), parse_aum_usd(F.col("estimated_aum")).alias("aum_usd"))


def _some(prefix: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(prefix), c))


def document_text() -> Column:
    """A record as one text, its parts joined by bars. (PRJ-03)"""
    place = F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in ("hq_city", "hq_state", "hq_country")])
    person = F.concat(F.col("principal_name"), F.coalesce(_some(", ", F.col("principal_title")), F.lit("")))
    return F.concat_ws(" | ", "name", "fo_type", F.nullif("description", F.lit("")), F.nullif("investment_thesis", F.lit("")),
        _some("Sectors: ", F.array_join("investing_sectors", ", ")), _some("Location: ", place), _some("AUM: ", F.col("estimated_aum")),
        F.when(filled(F.col("principal_name")), F.concat(F.lit("Principal: "), person)), F.transform("signals", lambda s: F.concat(F.lit("Recent activity: "), s.text)))


def focus_text() -> Column:
    """A record's topical evidence only; empty if it has none. (PRJ-04)"""
    return F.concat_ws(" | ", F.nullif("investment_thesis", F.lit("")), _some("Invests in sectors: ", F.array_join("investing_sectors", ", ")), F.transform("signals", lambda s: F.concat(F.lit("Recent investments: "), s.text)))


def principal() -> Column:
    """Name and title with a dash between. (PRJ-07)"""
    return F.when(filled(F.col("principal_name")), F.concat_ws(" — ", "principal_name", F.nullif("principal_title", F.lit(""))))


def short_aum(c: Column) -> Column:
    """The leading size of a text. (PRJ-08)"""
    return F.nullif(F.replace(F.regexp_extract(c, r"(?i)(\$\s*[\d.,]+\s*(?:billion|million|thousand|[bmk])?)", 1), F.lit(" "), F.lit("")), F.lit(""))


# What a source shows about the person that a record names, the most telling first.
ROLES = (
    ("SEC_EDGAR", "filing signatory (13F)"), ("SEC_IAPD", "registered person (Form ADV)"), ("FIRM_SITE", "listed person (website)"),
    ("NEWS", "mentioned in news"), ("DIRECTORY", "listed in directory"), ("IRS_990PF", "listed on IRS 990-PF"),
)
SHORT_LABELS = {"SEC_EDGAR": "SEC 13F/SC filing", "SEC_IAPD": "SEC Form ADV registration", "FIRM_SITE": "firm website", "IRS_990PF": "IRS 990-PF", "NEWS": "news", "DIRECTORY": "curated directory"}


def principal_role(sources: Column) -> Column:
    """The role that a record's best source supports. (PRJ-09)"""
    out = F.lit("named person (source not recorded)")
    classes = F.coalesce(F.transform(sources, lambda s: s.source_class), F.array().cast("array<string>"))
    for key, label in reversed(ROLES):
        out = F.when(F.array_contains(classes, SOURCE_CLASSES[key]), label).otherwise(out)
    return out


def short_labels(sources: Column) -> Column:
    """Sorted distinct labels of verification sources. (PRJ-06, PRJ-10, SET-05)"""
    pairs = [x for k, v in SHORT_LABELS.items() for x in (F.lit(SOURCE_CLASSES[k]), F.lit(v))]
    labels = F.create_map(*pairs)
    return F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.try_element_at(labels, s.source_class), s.source_class))))


def cards(records: DataFrame) -> DataFrame:
    """What an answer shows of each record. (PRJ-05)"""
    return records.select("fo_id", "name", "fo_type", "hq_city", "hq_state", "hq_country", short_aum(F.col("estimated_aum")).alias("aum"), principal().alias("principal"), principal_role(F.col("verification_sources")).alias("principal_role"), "website", "record_confidence", "data_as_of", short_labels(F.col("verification_sources")).alias("verified_by"))


def directory_rows(records: DataFrame) -> DataFrame:
    """Directory rows: base columns, labels and counts. (PRJ-06)"""
    return records.select(*[c for c in records.columns if c not in ("provenance", "signals", "verification_sources", "could_not_verify")], F.size("signals").alias("n_signals"), F.size("verification_sources").alias("n_sources"), short_labels(F.col("verification_sources")).alias("verified_by"), principal_role(F.col("verification_sources")).alias("principal_role"))


def leads(rows: DataFrame, name="candidate_name", kind="possible_type", site="website") -> DataFrame:
    """Raw leads as delivery values: type labels, https in front of sites, a default confidence. (PRJ-11)"""
    label = F.when(F.upper(kind) == "SFO", SFO).when(F.upper(kind) == "MFO", MFO).otherwise("Undetermined")
    address = F.when(filled(F.col(site)) & ~F.col(site).rlike("(?i)^https?://"), F.concat(F.lit("https://"), F.col(site))).otherwise(F.coalesce(F.col(site), F.lit("")))
    return rows.withColumn("name", F.trim(name)).withColumn("fo_type", label).withColumn("website", address).withColumn("record_confidence", F.lit("Low"))


def provenance_rows(records: DataFrame) -> DataFrame:
    """A row for each field that has provenance. (ARR-06)"""
    e = records.select("fo_id", F.explode("provenance").alias("field", "p"))
    return e.select("fo_id", "field", "p.source_class", "p.method", F.coalesce("p.source_url", F.lit("")).alias("source_url"), "p.confidence", F.col("p.checked_at").cast("string").alias("checked_at"), F.coalesce("p.note", F.lit("")).alias("note"))


def source_rows(records: DataFrame) -> DataFrame:
    """A row for each verification source and one for the discovery source. (ARR-07)"""
    row = lambda role, cls, verifies, url, at: F.struct(role.alias("role"), cls.alias("source_class"), verifies.alias("verifies"), url.alias("url"), at.alias("accessed_at"))
    checks = F.transform(F.coalesce("verification_sources", F.array().cast(RECORD["verification_sources"].dataType)), lambda s: row(F.lit("verification"), s.source_class, s.verifies, F.coalesce(s.url, F.lit("")), s.accessed_at.cast("string")))
    found = F.array(row(F.lit("discovery"), F.col("discovery_source"), F.lit(""), F.lit(""), F.col("data_as_of").cast("string")))
    return records.select("fo_id", F.explode(F.concat(checks, found)).alias("r")).select("fo_id", "r.*")


def provenance_violations() -> Column:
    """Fields that are filled without provenance, a type without evidence, signals without an address. (ARR-04)"""
    v = lambda field, reason: F.struct(field.alias("field"), F.lit(reason).alias("reason"))
    typed = F.when(F.col("fo_type").isin(SFO, MFO) & ~filled(F.col("fo_type_evidence")), v(F.lit("fo_type"), "classified as a family office without evidence"))
    known = F.map_keys("provenance")
    bare = [F.when(filled(F.col(c)) & ~F.coalesce(F.array_contains(known, c), F.lit(False)), v(F.lit(c), "populated without provenance")) for c in HIGH_VALUE_FIELDS]
    loose = F.array_compact(F.transform("signals", lambda s, i: F.when(~filled(s.source_url), v(F.concat(F.lit("signal["), i.cast("string"), F.lit("]")), "signal without a source_url"))))
    return F.concat(F.array_compact(F.array(typed, *bare)), F.coalesce(loose, F.array().cast("array<struct<field:string,reason:string>>")))


def independence_warnings() -> Column:
    """Verification sources of the discovery class, unless the notes say why. (ARR-05)"""
    excused = F.coalesce(F.contains("reviewer_notes", F.lit("same-source")), F.lit(False))
    same = F.filter("verification_sources", lambda s: (s.source_class == F.col("discovery_source")) & ~excused)
    return F.coalesce(F.transform(same, lambda s: F.concat(F.lit("verification source "), s.source_class, F.lit(" equals discovery source; document justification in reviewer_notes"))), F.array().cast("array<string>"))


def contradictions() -> Column:
    """Fields that are filled and listed as not verifiable. (ARR-03)"""
    texts = [f.name for f in RECORD.fields if f.dataType.simpleString() == "string"]
    populated = F.array_compact(F.array(*[F.when(filled(F.col(c)), F.lit(c)) for c in texts]))
    return F.array_intersect(F.coalesce("could_not_verify", F.array().cast("array<string>")), populated)


def is_verified(name: str) -> Column:
    """Whether a field's provenance is more than low."""
    return F.coalesce(F.try_element_at("provenance", F.lit(name)).confidence.isin("High", "Medium"), F.lit(False))


def to_json(records: DataFrame) -> DataFrame:
    """One JSON document a record. (JSN-04)"""
    return records.select("fo_id", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("payload"))


def from_json(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Records from JSON documents; what does not parse, or has no id, is left out. (JSN-04, MNT-14)"""
    return rows.select(F.from_json(column, RECORD, {"mode": "PERMISSIVE"}).alias("r")).where("r.fo_id IS NOT NULL").select("r.*")


def merged_sources(a: Column, b: Column) -> Column:
    """a and those of b whose class and subject a lacks. (SET-04)"""
    return F.concat(a, F.filter(b, lambda s: ~F.exists(a, lambda t: (t.source_class == s.source_class) & (t.verifies == s.verifies))))
