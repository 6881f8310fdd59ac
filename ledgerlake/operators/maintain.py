"""Maintenance of a store of records (MNT, SNK-03, SNK-04) and days of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SOURCE_CLASSES
from .filters import filled
from .relations import net_new


def rebuilt_provenance(records: DataFrame, rules: dict[str, list[tuple[Column, str, str]]], as_of: str) -> DataFrame:
    """Provenance by the first rule (test, class, method) of each field that holds; fields without one get none. (MNT-01, MNT-04)"""
    entries = []
    for field, cases in rules.items():
        value = F.lit(None)
        for test, cls, method in reversed(cases):
            one = F.struct(F.lit(cls).alias("source_class"), F.lit(method).alias("method"), F.lit(as_of).cast("date").alias("checked_at"), F.lit(None).cast("string").alias("source_url"), F.lit("Medium").alias("confidence"),
                F.lit(None).cast("string").alias("note"), F.lit(None).cast("date").alias("fetched_at"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("snapshot_path"))
            value = F.when(test, one).otherwise(value)
        entries.append(F.when(filled(F.col(field)) & value.isNotNull(), F.struct(F.lit(field).alias("key"), value.alias("value"))))
    return records.withColumn("provenance", F.map_from_entries(F.array_compact(F.array(*entries))))


def rebuilt_sources(cell: Column, as_of: str, fallback: str = "SEC_EDGAR") -> Column:
    """Sources whose label stands in a cell, or the fallback. (SRC-04, MNT-02)"""
    ref = lambda label: F.struct(label.alias("source_class"), F.lit("firm identity").alias("verifies"), F.lit(as_of).cast("date").alias("accessed_at"), F.lit(None).cast("string").alias("url"))
    found = F.filter(F.array(*[F.lit(v) for v in SOURCE_CLASSES.values()]), lambda v: F.contains(cell, v))
    return F.when(F.size(found) > 0, F.transform(found, ref)).otherwise(F.array(ref(F.lit(SOURCE_CLASSES[fallback]))))


SITE_FIELDS = ("website", "corporate_linkedin", "principal_linkedin", "principal_email", "firm_contact_email", "investment_thesis", "description")


def without_site(records: DataFrame, bad: Column) -> DataFrame:
    """Records of a wrong site lose what came from it and say so. (MNT-05)"""
    site = SOURCE_CLASSES["FIRM_SITE"]
    out = records
    for c in SITE_FIELDS:
        out = out.withColumn(c, F.when(~bad, F.col(c)))
    out = out.withColumn("verification_sources", F.when(bad, F.filter("verification_sources", lambda s: s.source_class != site)).otherwise(F.col("verification_sources")))
    out = out.withColumn("provenance", F.when(bad, F.map_filter("provenance", lambda k, v: v.source_class != site)).otherwise(F.col("provenance")))
    return out.withColumn("could_not_verify", F.when(bad, F.array_union("could_not_verify", F.array(*[F.lit(c) for c in SITE_FIELDS]))).otherwise(F.col("could_not_verify")))


def restored(current: DataFrame, archived: DataFrame, key: str = "fo_id") -> DataFrame:
    """current and what only the archive has. (MNT-06)"""
    return current.unionByName(net_new(archived, current, key))


def patched_signals(records: DataFrame, urls: DataFrame, source: str | None = None, verifies: str = "", key: str = "fo_id") -> DataFrame:
    """Signals without an address get that of urls(key, url); records of urls get a source of the class where they have none. (MNT-08)"""
    met = records.join(urls.groupBy(key).agg(F.min("url").alias("_url")), key, "left")
    fixed = F.transform("signals", lambda s: s.withField("source_url", F.coalesce(F.nullif(s.source_url, F.lit("")), F.col("_url"))))
    out = met.withColumn("signals", fixed)
    if source is not None:
        kind = records.schema["verification_sources"].dataType
        more = F.array(F.struct(F.lit(source).alias("source_class"), F.lit(verifies).alias("verifies"), F.lit(None).cast("date").alias("accessed_at"), F.col("_url").alias("url"))).cast(kind)
        now = F.coalesce("verification_sources", F.array().cast(kind))
        lacks = F.col("_url").isNotNull() & ~F.exists(now, lambda s: s.source_class == source)
        out = out.withColumn("verification_sources", F.when(lacks, F.concat(now, more)).otherwise(F.col("verification_sources")))
    return out.drop("_url")


def unverified(records: DataFrame) -> DataFrame:
    """Records that no class but the discovery class verifies. (MNT-09)"""
    other = F.filter("verification_sources", lambda s: s.source_class != F.col("discovery_source"))
    return records.where(F.coalesce(F.size(other), F.lit(0)) <= 0)


def marked(rows: DataFrame, marker: str) -> DataFrame:
    """Candidates that a marked source found. (MNT-10)"""
    return rows.where(F.array_contains("discovery_sources", marker))


def filled_up(store: DataFrame, rows: DataFrame, target: int, keys: tuple[str, ...] = ("name_key", "site_key"), ordinal: str = "ordinal") -> DataFrame:
    """As many new rows, in order, as the store lacks to target. (MNT-11)"""
    need = max(0, target - store.count())
    return net_new(rows, store, *keys, order=ordinal).orderBy(ordinal).limit(need)


def fill_empty(records: DataFrame, facts: DataFrame, columns: list[str], guard: Column, key: str = "fo_id") -> DataFrame:
    """Empty columns get the facts' values where the guard holds. (MNT-12)"""
    met = records.join(facts.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    for c in columns:
        met = met.withColumn(c, F.when(~filled(F.col(c)) & guard & filled(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c))).drop(f"_{c}")
    return met


def plausible(name_core: Column, site: Column, description: Column, from_web: Column) -> Column:
    """Whether a web find's name stands in its site or description. (MNT-13)"""
    squashed = F.regexp_replace(F.lower(F.coalesce(site, F.lit(""))), "[^a-z0-9]", "")
    told = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9]", "")
    return ~from_web | ((name_core != "") & (F.contains(squashed, name_core) | F.contains(told, name_core)))


def upserted(store: DataFrame, batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """store with the last row of batch for each key in place of its own. (SNK-04)"""
    others = [c for c in store.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*others), ordinal).alias("r")).select(key, "r.*")
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def history(runs: DataFrame, builds: DataFrame, day: str = "day") -> DataFrame:
    """Runs and builds for each day that has either. (MNT-16)"""
    a, b = runs.groupBy(day).agg(F.count("*").alias("runs")), builds.groupBy(day).agg(F.count("*").alias("builds"))
    return a.join(b, day, "full").select(day, F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("builds", F.lit(0)).alias("builds"))


def previous(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with the value before, by key."""
    return rows.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(at)))
