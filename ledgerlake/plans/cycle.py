"""The batch pipeline and its cycles (CYC, GAT-10, GAT-11, GOV-06): each channel is a table, each stage a function of tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, compute, gates, relations, resolve
from ..operators.lineage import cut
from ..sources import sinks

LIMIT_ROWS, LIMIT_CHARS = 2000, 8 << 20


@dataclass
class Release:
    released: DataFrame
    outcomes: DataFrame
    contacts: DataFrame
    store: DataFrame


def release(records: DataFrame, decisions: DataFrame, cleared: DataFrame, store: DataFrame, audit: DataFrame | None = None) -> Release:
    """Approved records that pass the gates and are not there yet; contacts that are not cleared are left out. (GOV-06, JOIN-05, JOIN-06)"""
    approved = relations.either_key_semi(records, decisions.where("action = 'approve'"), "fo_id", "name")
    ok = cleared.where("contact_action = 'autonomous'").select("fo_id").distinct().withColumn("_ok", F.lit(True))
    met = approved.join(ok, "fo_id", "left")
    for c in ("principal_email", "principal_email_status"):
        met = met.withColumn(c, F.when(F.col("_ok"), F.col(c)))
    met = met.withColumn("provenance", F.when(F.col("_ok"), F.col("provenance")).otherwise(F.map_filter("provenance", lambda k, v: k != "principal_email"))).drop("_ok").select(*records.columns)
    passed, outcomes = gates.publish(met, audit)
    fresh = relations.net_new(passed, store, "fo_id").select(*store.columns)
    return Release(fresh, outcomes, cleared, store.unionByName(fresh))


def contact_decisions(records: DataFrame) -> DataFrame:
    """Review of the named-person mailbox of each record that has one. (GOV-03)"""
    rows = records.where(F.coalesce(F.col("principal_email") != "", F.lit(False)))
    confidence = F.when(F.coalesce("principal_email_status", F.lit("risky")) == "risky", 0.75).otherwise(0.95)
    return rows.select("fo_id", "name", classify.review_contact(F.col("principal_name"), F.col("principal_email"), F.lit("corporate"), F.lit("firm_site"), confidence).alias("contact_action"))


def decide(records: DataFrame) -> DataFrame:
    """Governance of records by their own confidence, type and sources. (GOV-01, GOV-02, JOIN-04)"""
    rows = records.select("fo_id", "name", "fo_type", F.col("fo_type_confidence").alias("confidence"), F.coalesce(F.col("fo_type_evidence") != "", F.lit(False)).alias("evident"), classify.authoritative_sources(F.col("verification_sources")).alias("n_sources"))
    return classify.govern(rows)


def build(records: DataFrame, target: int = 50, audit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected records, why others were withheld): dedupe, gate, balanced selection. (GAT-11, WIN-03)

    records have an ordinal.
    """
    merged = resolve.dedupe_records(records).drop("n_merged")
    passed, outcomes = gates.publish(merged, audit)
    rank = F.when(F.col("record_confidence") == "High", 3).when(F.col("record_confidence") == "Medium", 2).otherwise(1)
    reachable = F.coalesce(F.col("principal_email") != "", F.lit(False)) | F.coalesce(F.col("principal_phone") != "", F.lit(False)) | F.coalesce(F.col("principal_linkedin") != "", F.lit(False))
    kind = F.when(F.col("fo_type") == "Single-Family Office", 2).when(F.col("fo_type") == "Multi-Family Office", 1).otherwise(0)
    quality = [rank.desc(), reachable.desc(), (F.size("signals") > 0).desc(), kind.desc()]
    return relations.balanced(passed, "discovery_source", quality, "ordinal", target), compute.failures(outcomes)


def within_limits(tables: dict[str, DataFrame], rows: int = LIMIT_ROWS, chars: int = LIMIT_CHARS) -> DataFrame:
    """(name, n, chars, ok) of each channel. (CYC-10, JSN-06)"""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("chars")).select(F.lit(name).alias("name"), "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", (F.col("n") <= rows) & (F.col("chars") <= chars))


def refresh_trust(current: DataFrame, folder: str, version: str) -> DataFrame | None:
    """Changes since the snapshot before; the current one takes its place. None on the first run. (CYC-03)"""
    spark = current.sparkSession
    now = classify.trust_snapshot(current)
    prior = sinks.read_current(spark, folder)
    changes = cut(classify.trust_changes(prior, now)) if prior is not None else None
    sinks.write_version(now, folder, version)
    return changes


@dataclass
class Backfill:
    """A loop of cycles with what it did. (CYC-04, CYC-05, CYC-07, CYC-08)"""

    target: int
    budget_s: float
    fatal_most: int = 3
    cycles: list[dict] = field(default_factory=list)
    done: set[str] = field(default_factory=set)

    def run(self, cycle: Callable[[int], dict], allowed: Callable[[str], bool] = lambda _: True, clock: Callable[[], float] = time.monotonic) -> str:
        """cycle(number) gives gate_passing and fatal; the loop ends at the target, the deadline, or after fatal cycles in a row."""
        began, fatal, before = clock(), 0, 0
        while True:
            name = f"cycle-{len(self.cycles)}"
            if not allowed(name):
                return "halted"
            if name not in self.done:  # a cycle that was done is not done again
                got = cycle(len(self.cycles))
                self.cycles.append(got | {"delta": got["gate_passing"] - before})
                before = got["gate_passing"]
                self.done.add(name)
            fatal = fatal + 1 if self.cycles[-1].get("fatal") else 0
            if before >= self.target:
                return "target"
            if fatal >= self.fatal_most:
                return "safety"
            if clock() - began >= self.budget_s:
                return "deadline"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, int(c["gate_passing"]), int(c["delta"]), bool(c.get("fatal"))) for i, c in enumerate(self.cycles)]
        return spark.createDataFrame(rows, "cycle int, gate_passing int, delta int, fatal boolean")
