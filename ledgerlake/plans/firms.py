"""Records made of the customers table, for queries whose operators work on records: one definition in Spark SQL and DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HIGH_VALUE_FIELDS, RECORD, SOURCE_CLASSES

_C = {k: v.replace("'", "''") for k, v in SOURCE_CLASSES.items()}
_SOURCE = "CASE {n} % 5 " + " ".join(f"WHEN {i} THEN '{_C[k]}'" for i, k in enumerate(("SEC_EDGAR", "SEC_IAPD", "FIRM_SITE", "DIRECTORY"))) + f" ELSE '{_C['NEWS']}' END"


def _signal(i: int) -> str:
    return f"ROW(text: concat('bought share {i} of ', CAST(k AS STRING)); source_class: '{_C['NEWS']}'; event_date: DATE '2025-0{i + 1}-01'; source_url: CASE WHEN (k + {i}) % 11 = 0 THEN '' ELSE 'https://news.example.com/{i}' END; confidence: CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Low' END)"


def _source(i: int) -> str:
    return f"ROW(source_class: {_SOURCE.format(n=f'(k + {2 * i})')}; verifies: '{('identity', 'type', 'contact')[i]}'; accessed_at: DATE '2025-01-0{i + 1}'; url: CASE WHEN k % 3 = {i} THEN 'https://example.com/{i}' END)"


def _proof(name: str) -> str:
    return f"ROW(field: '{name}'; source_class: {_SOURCE.format(n='k')}; method: 'filing'; checked_at: DATE '2025-01-02'; source_url: CASE WHEN k % 4 = 0 THEN 'https://example.com/p' END; confidence: CASE (k + {len(name)}) % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END; note: CASE WHEN k % 5 = 0 THEN 'seen' END)"


#: Columns of a record over k (the customer's key), seg (its segment) and nat (its nation's name), in the SQL that both engines share; LIST, ROW and HEAD differ.
COLUMNS = {
    "fo_id": "concat('fo_', CAST(k AS STRING))",
    "name": "CASE WHEN k % 50 = 0 THEN '' ELSE concat('Firm ', CAST(k % 400 AS STRING), ' Family Office LLC') END",
    "fo_type": "CASE k % 5 WHEN 0 THEN 'Single-Family Office' WHEN 1 THEN 'Multi-Family Office' ELSE 'Undetermined' END",
    "fo_type_evidence": "CASE WHEN k % 4 <> 0 THEN 'states so' END",
    "fo_type_confidence": "CASE k % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END",
    "description": "CASE WHEN k % 6 <> 0 THEN concat('A firm of ', nat) END",
    "investment_thesis": "CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 < 4 THEN concat('Invests in ', lower(seg)) END",
    "investing_sectors": "HEAD(LIST(seg, 'Healthcare'), k % 3)",
    "estimated_aum": "CASE k % 4 WHEN 0 THEN concat('$', CAST(k % 900 + 1 AS STRING), ' million (13F)') WHEN 1 THEN concat('$', CAST(k % 9 + 1 AS STRING), '.5B regulatory AUM (ADV)') WHEN 2 THEN 'not stated' END",
    "website": "CASE WHEN k % 5 <> 2 THEN concat('https://www.firm', CAST(k AS STRING), '.example.com') END",
    "corporate_linkedin": "CASE WHEN k % 9 = 0 THEN 'https://www.linkedin.com/company/x' END",
    "hq_city": "CASE WHEN k % 8 <> 0 THEN 'Springfield' END",
    "hq_state": "CASE k % 6 WHEN 1 THEN 'TX' WHEN 2 THEN 'ny' WHEN 3 THEN '' END",
    "hq_country": "CASE WHEN k % 16 <> 0 THEN nat END",
    "hq_phone": "CASE WHEN k % 10 = 0 THEN '+1 (555) 010-2030' END",
    "principal_name": "CASE WHEN k % 4 <> 1 THEN concat('Jane Roe', CAST(k AS STRING)) END",
    "principal_title": "CASE WHEN k % 8 = 2 THEN 'Founder' END",
    "principal_linkedin": "CASE WHEN k % 6 = 2 THEN 'https://www.linkedin.com/in/jane' END",
    "principal_email": "CASE k % 7 WHEN 3 THEN 'jane@firm.example.com' WHEN 4 THEN 'info@firm.example.com' END",
    "principal_email_status": "CASE WHEN k % 14 = 3 THEN 'deliverable' WHEN k % 7 = 3 THEN 'could_not_verify' END",
    "principal_phone": "CASE WHEN k % 12 = 0 THEN '+1 (555) 010-0000' END",
    "firm_contact_email": "CASE WHEN k % 5 = 1 THEN 'office@firm.example.com' END",
    "firm_contact_email_status": "CASE WHEN k % 5 = 1 THEN 'risky' END",
    "signals": f"HEAD(LIST({', '.join(map(_signal, range(3)))}), k % 4)",
    "discovery_source": _SOURCE.format(n="(k + 1)"),
    "verification_sources": f"HEAD(LIST({', '.join(map(_source, range(3)))}), CAST(floor(k / 3) AS INT) % 4)",
    "reviewer_notes": "CASE WHEN k % 6 = 5 THEN 'same-source confirmed by phone' END",
    "record_confidence": "CASE CAST(floor(k / 2) AS INT) % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END",
    "data_as_of": "CAST(CASE WHEN k % 9 <> 1 THEN concat('2024-0', CAST(k % 9 + 1 AS STRING), '-15') END AS DATE)",
    "could_not_verify": "HEAD(LIST('hq_phone', 'website'), CAST(floor(k / 5) AS INT) % 3)",
    "proofs": f"HEAD(LIST({', '.join(map(_proof, HIGH_VALUE_FIELDS))}), CASE k % 4 WHEN 2 THEN 6 WHEN 3 THEN 11 ELSE 14 END)",
}


def _inside(text: str, at: int) -> int:
    """Where the bracket that opens at a place closes."""
    depth, quoted = 0, False
    for i in range(at, len(text)):
        quoted ^= text[i] == "'"
        depth += 0 if quoted else (text[i] == "(") - (text[i] == ")")
        if not depth and not quoted:
            return i
    raise ValueError("unbalanced")


def dialect(text: str, spark: bool) -> str:
    """The shared SQL as Spark or DuckDB reads it."""
    text = re.sub(r"\bLIST\(", "array(" if spark else "list_value(", text)
    while m := re.search(r"\bHEAD\(", text):
        end = _inside(text, m.end() - 1)
        body, _, n = text[m.end() : end].rpartition("), ")
        text = text[: m.start()] + f"{'slice' if spark else 'list_slice'}({body}), 1, CAST({n} AS INT))" + text[end + 1 :]
    while m := re.search(r"\bROW\(", text):
        end = _inside(text, m.end() - 1)
        fields = [f.strip().split(": ", 1) for f in text[m.end() : end].split("; ")]
        inner = ", ".join(f"'{n}', {v}" if spark else f"{n} := {v}" for n, v in fields)
        text = text[: m.start()] + f"{'named_struct' if spark else 'struct_pack'}({inner})" + text[end + 1 :]
    return text


def records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer, in the record schema."""
    customers, nations = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    base = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("n_name").alias("nat"))
    rows = base.selectExpr(*[f"{dialect(e, True)} AS {n}" for n, e in COLUMNS.items()])
    none = F.lit(None)
    value = lambda p: F.struct(*[(p[f.name] if f.name in ("source_class", "method", "checked_at", "source_url", "confidence", "note") else none.cast(f.dataType)).alias(f.name) for f in RECORD["provenance"].dataType.valueType.fields])
    rows = rows.withColumn("provenance", F.map_from_entries(F.transform("proofs", lambda p: F.struct(p.field.alias("key"), value(p).alias("value")))))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in RECORD.fields])


def audit(records: DataFrame) -> DataFrame:
    """Rejected values: the website of some firms, and a value that no firm delivers."""
    k = F.substring("fo_id", 4, 20).cast("long")
    return records.select("fo_id", F.when(k % 13 == 0, F.col("website")).when(k % 17 == 0, "never shipped").alias("rejected_value")).where("rejected_value IS NOT NULL")


#: The same records in DuckDB: f; provenance is the list proofs.
FIRMS = (
    "WITH b AS (SELECT c_custkey AS k, c_mktsegment AS seg, n_name AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT k, seg, nat, "
    + ", ".join(f"{dialect(e, False)} AS {n}" for n, e in COLUMNS.items())
    + " FROM b)"
)
