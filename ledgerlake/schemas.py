"""Record schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of classes, types and fields as delivered.
SFO, MFO, UNDETERMINED = "Single-Family Office", "Multi-Family Office", "Undetermined"
CONFIDENCE_RANK = {"Low": 1, "Medium": 2, "High": 3}
EMAIL_STATUSES = ("deliverable", "risky", "undeliverable", "could_not_verify")
SOURCE_CLASSES = {
    "SEC_EDGAR": "SEC EDGAR (13F / SC / Form D filings)",
    "IRS_990PF": "IRS 990-PF (ProPublica Nonprofit Explorer)",
    "NEWS": "News / Press (GDELT)",
    "DIRECTORY": "Curated directory / reference (Wikipedia, associations)",
    "WEB": "Web search (Tavily)",
    "EXA": "Web search (EXA)",
    "SERP": "Web search (Serper)",
    "SEC_IAPD": "SEC IAPD / Form ADV (investment-adviser registration)",
    "FIRM_SITE": "Firm Website",
    "LINKEDIN": "LinkedIn (public profile)",
    "CROSS_SOURCE": "Cross-source corroboration",
    "OTHER": "Other",
}
DISCOVERY_ONLY = (SOURCE_CLASSES["DIRECTORY"],)
MEASURE_TYPES = ("13F_securities_value", "regulatory_aum", "estimated_wealth", "unknown")
HIGH_VALUE_FIELDS = (
    "name", "description", "investment_thesis", "estimated_aum", "website", "corporate_linkedin", "hq_country",
    "hq_phone", "principal_name", "principal_title", "principal_linkedin", "principal_email", "principal_phone", "firm_contact_email",
)
CONFIDENCE_FIELDS = (
    "name", "fo_type", "principal_name", "principal_email", "principal_phone", "firm_contact_email", "website",
    "corporate_linkedin", "principal_linkedin", "estimated_aum", "investment_thesis", "recent_activity",
)
BASE_COLUMNS = (
    "fo_id", "family_office_name", "fo_type", "classification_evidence", "description", "investment_thesis",
    "investing_sectors", "estimated_aum", "website", "corporate_linkedin", "hq_city", "hq_state", "hq_country", "hq_phone",
    "principal_name", "principal_title", "principal_linkedin", "principal_email", "principal_email_status", "principal_phone",
    "firm_contact_email", "firm_contact_email_status",
)
TRUST_FIELDS = (
    "fo_type", "fo_type_evidence", "fo_type_confidence", "record_confidence", "principal_name", "principal_email",
    "principal_email_status", "principal_linkedin", "principal_phone", "firm_contact_email", "estimated_aum",
)
REQUIRED_FIELDS = ("name", "fo_type_evidence", "geography", "verification_source")
INTELLIGENCE_FIELDS = (
    "description", "investment_thesis", "estimated_aum", "website", "principal_name", "principal_title", "hq_phone",
    "principal_phone", "principal_email", "principal_linkedin", "corporate_linkedin", "signals", "firm_contact_email",
)

_S, _D, _B = T.StringType(), T.DateType(), T.BooleanType()


def _fields(names: str, **others: T.DataType) -> T.StructType:
    """Columns in order, text where others does not say otherwise."""
    return T.StructType([T.StructField(n, others.get(n, _S)) for n in names.split()])


PROVENANCE = _fields("source_class method checked_at source_url confidence note fetched_at content_hash snapshot_path", checked_at=_D, fetched_at=_D)
SIGNAL = _fields("text source_class event_date source_url confidence", event_date=_D)
SOURCE_REF = _fields("source_class verifies accessed_at url", accessed_at=_D)
RECORD = _fields(
    "fo_id name fo_type fo_type_evidence fo_type_confidence description investment_thesis investing_sectors estimated_aum website corporate_linkedin "
    "hq_city hq_state hq_country hq_phone principal_name principal_title principal_linkedin principal_email principal_email_status principal_phone "
    "firm_contact_email firm_contact_email_status signals discovery_source verification_sources reviewer_notes record_confidence data_as_of could_not_verify provenance",
    investing_sectors=T.ArrayType(_S), signals=T.ArrayType(SIGNAL), verification_sources=T.ArrayType(SOURCE_REF), data_as_of=_D, could_not_verify=T.ArrayType(_S), provenance=T.MapType(_S, PROVENANCE),
)
_M = T.MapType(_S, _S)
CANDIDATE = _fields(
    "ordinal name source_class source_url discovered_at dedup_key identifiers discovery_sources raw hints",
    ordinal=T.LongType(), discovered_at=_D, identifiers=_M, discovery_sources=T.ArrayType(_S), raw=_M, hints=_M,
)
AUDIT = _fields("fo_id field rejected_value reason source_class checked_at", checked_at=_D)
LABEL = _fields("firm_name is_family_office true_type note", is_family_office=_B)
DELIVERY = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        *BASE_COLUMNS,
        *(f"recent_signal_{i}{part}" for i in (1, 2, 3) for part in ("", "_date", "_source")),
        *(f"{c}_confidence" for c in CONFIDENCE_FIELDS),
        "discovery_source", "verification_sources", "record_confidence", "data_as_of", "could_not_verify", "reviewer_notes",
    )]
)
