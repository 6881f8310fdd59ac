"""Questions as a table against the same questions read and answered one by one."""

import itertools

from ledgerlake.operators import filters
from ledgerlake.plans import answer, questions

TEXTS = [
    "How many single family offices are in Texas?", "HOW MANY SFOS IN TEXAS?", "count of multi-family offices in West Virginia", "number of family offices in New York or newyork", "how many MFOs in OR", "how many mfos in or out",
    "family offices in tx with over $1.5 billion", "offices under 3,000 k and over 2 m", "firms above 1.2.3 billion, at least .5 million", "min 5 b", "minimum 5 b", "total 13F assets of family offices in France",
    "How many family offices are there and what is their total regulatory AUM?", "total number of family offices with wealth", "Do all family offices have a principal email?", "does every family office list a web site in Texas",
    "all family offices are nice", "no family office has a phone", "any family offices hold 13(f) securities", "sum of wealth in the u.k. and the UK", "combined aum in u.s. and u.s.a. now", "America first", "south-dakota and north carolina sfo",
    "ny, CA", "in ca, ny", "Germany and Virginia", "", None, "   ", "what is the weather", "IN OHIO", "In OH", "WA", "wa", "over 5 million under 2 million", "$3 m", "more than $7K of assets in Switzerland", "total aum in Texas of single-family offices",
    "how many family offices\nin new\nyork", "Straße in Köln: wie viele sfo? how many", "how many sfos in Belgium, Texas",
]
COLUMNS = ("fo_type", "hq_state", "hq_country", "aum_min", "aum_max")


def test_read(spark):
    more = [f"{a} {b} {c}" for a, b, c in itertools.product(("how many", "total aum of", ""), ("sfo", "multi family offices", "every family office has a website"), (*filters.STATES, *filters.STATES.values(), *filters.COUNTRIES))]
    texts = list(enumerate(TEXTS + more))
    got = {r["question_id"]: r for r in questions.read(spark.createDataFrame(texts, "question_id int, text string")).collect()}
    for i, t in texts:
        p, r = answer.plan(t or ""), got[i]
        assert (r["mode"], r["subject"], r["measure"]) == (p.mode, p.subject, p.measure), t
        assert {c: r[c] for c in COLUMNS if r[c] is not None} == p.conditions, t


def test_answers(spark, records):
    many = [{"fo_id": f"fo_{i}", "fo_type": ("Single-Family Office", "Multi-Family Office", None)[i % 3], "hq_state": ("TX", None, "", "NY")[i % 4], "hq_country": ("United States", "France", None)[i % 3], "principal_email": ("a@b.c", "", " ", None)[i % 4],
             "estimated_aum": ("$5 million (13F)", "$1.5B regulatory AUM", None, "none")[i % 4]} for i in range(40)]
    df = records(*many)
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "question_id int, text string")
    got = {r["question_id"]: r for r in questions.answers(df, asked).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        p, r = answer.plan(t or ""), got[i]
        if p.mode == "universal":
            one = answer.aggregate(df, p).first()
            assert (r["have_field"], r["total_records"]) == (one["have_field"], one["total"]), t
        if p.mode in ("count", "both"):
            one = answer.aggregate(df, answer.replace(p, mode="count")).first()
            assert (r["qualified"], r["total_records"]) == (one["value"], one["total_records"]), t
        if p.mode in ("total", "both"):
            one = answer.aggregate(df, answer.replace(p, mode="total")).first()
            assert (r["total"], r["included"], r["qualified"]) == (one["value"], one["included_in_calc"], one["qualified"]), t
        if p.mode == "retrieve":
            assert r["qualified"] is r["total"] is r["have_field"] is r["total_records"] is None


def test_no_rows(spark, records):
    asked = spark.createDataFrame([(1, "how many sfo in Texas"), (2, "all family offices have a website")], "question_id int, text string")
    none = records({}).limit(0)
    assert sorted((r["question_id"], r["qualified"], r["have_field"]) for r in questions.answers(none, asked).collect()) == [(1, 0, None), (2, None, 0)]
    assert questions.answers(none, asked.limit(0)).count() == 0
