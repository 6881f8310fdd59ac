"""JSON in columns (JSN): nested payloads with defaults, parallel arrays, blocks in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBMISSION = """struct<name:string,phone:string,ein:string,website:string,sic:string,tickers:array<string>,exchanges:array<string>,formerNames:array<struct<name:string>>,
addresses:struct<business:struct<street1:string,city:string,stateOrCountry:string,stateOrCountryDescription:string,zipCode:string>>,
filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>>>>""".replace("\n", "")


def registry_facts(payload: Column) -> Column:
    """Facts of a registry submission; what is missing is null. (JSN-01, SRC-21)"""
    from .text import ein, phone

    p = F.from_json(payload, SUBMISSION)
    b = p.addresses.business
    public = (F.coalesce(F.size(p.tickers), F.lit(0)) > 0) | (F.coalesce(F.size(F.filter(p.exchanges, lambda x: x.isNotNull())), F.lit(0)) > 0)
    return F.struct(p["name"].alias("legal_name"), phone(p.phone).alias("phone"), ein(p.ein).alias("ein"), F.nullif(p.website, F.lit("")).alias("website"), p.sic.alias("sic"), public.alias("is_public"), b.street1.alias("street1"), b.city.alias("city"), b.stateOrCountry.alias("state"), F.transform(p.formerNames, lambda f: f["name"]).alias("former_names"))


def nested_address(details: Column) -> Column:
    """City, state and country from a JSON text inside a JSON text; null if it is none. (JSN-02)"""
    a = F.from_json(details, "struct<officeAddress:struct<city:string,state:string,country:string>>").officeAddress
    return F.struct(a.city.alias("city"), a.state.alias("state"), a.country.alias("country"))


def filings(recent: Column, prefix: str = "13F-HR") -> Column:
    """Parallel arrays as rows, of forms with a prefix. (JSN-03)"""
    rows = F.arrays_zip(recent.form.alias("form"), recent.accessionNumber.alias("accession"), recent.filingDate.alias("filed"))
    return F.filter(rows, lambda r: r.form.startswith(prefix))


def json_block(text: Column, kind: str = "object") -> Column:
    """The first to the last bracket of free text, without code fences; null if that is no JSON. (JSN-05)"""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}" if kind == "object" else r"(?s)\[.*\]", 0)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def serialized_size(*columns: str) -> Column:
    """Characters of columns as JSON. (JSN-06, CYC-10)"""
    return F.length(F.to_json(F.struct(*columns)))
