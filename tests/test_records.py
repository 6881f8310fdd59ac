import random
from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlake.functions.text import norm_name
from ledgerlake.operators import classify as C
from ledgerlake.operators import compute as A
from ledgerlake.operators import filters as P
from ledgerlake.operators import gates, maintain, records, resolve
from ledgerlake.operators import retrieve as V
from ledgerlake.plans import answer, cycle
from ledgerlake.schemas import CANDIDATE, DELIVERY, SOURCE_CLASSES

DIRECTORY, NEWS = SOURCE_CLASSES["DIRECTORY"], SOURCE_CLASSES["NEWS"]
REF = lambda cls: Row(source_class=cls, verifies="x", accessed_at=date(2025, 1, 1), url=None)


def test_delivery_row(records):
    from ledgerlake.operators.records import delivery

    flat = delivery(records({}, {"fo_id": "fo_2", "signals": None, "investing_sectors": None, "verification_sources": None, "could_not_verify": None}))
    assert flat.columns == DELIVERY.names and len(flat.columns) == 49
    rows = {r["fo_id"]: r for r in flat.collect()}
    assert rows["fo_1"]["recent_signal_1"] == "bought shares" and rows["fo_1"]["recent_signal_2"] == "" and rows["fo_1"]["name_confidence"] == "High"
    assert None not in rows["fo_2"].asDict().values()


@pytest.mark.parametrize(
    ("change", "failing"),
    [
        ({}, set()), ({"fo_type_evidence": None}, {"family_office_evidenced", "classification_evidence", "provenance_complete"}),
        ({"verification_sources": [REF(DIRECTORY)]}, {"verification_documented", "verification_authoritative"}),
        ({"verification_sources": [REF(NEWS)]}, {"no_contradictions"}), ({"verification_sources": [REF(NEWS)], "reviewer_notes": "same-source ok"}, set()),
        ({"description": "d", "provenance": {}}, {"provenance_complete"}), ({"website": None, "signals": [], "investment_thesis": None}, {"mandatory_fields_complete"}),
        ({"hq_country": None, "hq_state": None}, {"mandatory_fields_complete"}), ({"discovery_source": None}, {"discovery_documented"}),
    ],
)
def test_gates(records, change, failing):
    got = gates.evaluate(records(change)).select("passed", F.filter("checks", lambda c: ~c.passed).alias("f")).first()
    assert {c["name"] for c in got["f"]} == failing and got["passed"] == (not failing)


def test_rejected_values_do_not_ship(spark, records):
    from ledgerlake.schemas import AUDIT

    audit = spark.createDataFrame([("fo_1", "principal_name", "Jane Roe", "wrong", NEWS, date(2025, 1, 1))], AUDIT)
    released, outcomes = gates.publish(records({}, {"fo_id": "fo_2"}), audit)
    assert [r["fo_id"] for r in released.collect()] == ["fo_2"] and outcomes.count() == 2
    assert A.failures(outcomes).first()["reason"].startswith("no_rejected_values_shipped")


def test_completeness_and_coverage(records):
    df = records({}, {"fo_id": "fo_2", "fo_type_evidence": None, "principal_name": None})
    got = {r["fo_id"]: r for r in gates.completeness(df, "2025-01-11").collect()}
    assert got["fo_1"]["fully_enriched"] and got["fo_1"]["freshness_days"] == 10 and got["fo_2"]["missing_fields"] == ["fo_type_evidence"]
    c = gates.coverage(df, "2025-01-11").first()
    assert (c["total_records"], c["released_records"], c["named_person_coverage"]) == (2, 1, 0.5)
    empty = gates.coverage(df.limit(0), "2025-01-11").first().asDict()
    assert set(empty.values()) <= {0, 0.0}
    assert gates.gate_passing_count(df).first()[0] == 1


def test_provenance_and_sources(records):
    df = records({})
    from ledgerlake.operators import records as R

    assert R.provenance_rows(df).count() == 10 and R.source_rows(df).count() == 3
    assert df.select(R.record_confidence()).first()[0] == "High"
    assert records({"could_not_verify": ["website"]}).select(R.contradictions()).first()[0] == ["website"]
    assert R.from_json(R.to_json(df)).collect() == df.collect()
    assert df.select(R.principal_role(F.col("verification_sources"))).first()[0] == "filing signatory (13F)"
    assert R.cards(df).first()["principal"] == "Jane Roe"
    assert "Location: TX, United States" in df.select(R.document_text()).first()[0]


def test_parse_filters():
    assert P.parse_filters("single family offices in New York") == {"fo_type": "Single-Family Office", "hq_state": "NY"}
    assert P.parse_filters("multi-family offices with AUM over $500M") == {"fo_type": "Multi-Family Office", "aum_min": 500_000_000}
    assert P.parse_filters("offices in in Belgium under $1 billion") == {"hq_country": "Belgium", "aum_max": 1_000_000_000}
    assert P.parse_filters("TELL ME ABOUT THEM") == {} and P.parse_filters("offices in OR") == {"hq_state": "OR"} and P.parse_filters("hello") == {}
    assert P.parse_filters("west virginia or Texas firms, USA, max $2.5b, min 1k") == {"hq_state": "TX", "aum_max": 2_500_000_000}
    assert P.parse_filters("sfos and mfos in tx or ny") == {"fo_type": "Single-Family Office", "hq_state": "TX"} and P.parse_size("over 1.2.3 million") == {} == P.parse_size("over 5")


def test_totals(spark, records):
    df = records({"estimated_aum": "$10M in 13(f) securities"}, {"fo_id": "b", "estimated_aum": "$5M regulatory AUM"}, {"fo_id": "c"})
    m = answer.measures(df)
    with pytest.raises(A.MixedMeasureError):
        A.typed_total(df, m, F.lit(True))
    with pytest.raises(A.ComputeError):
        A.typed_total(df, m, F.lit(True), "REGULATORY_AUM")
    got = A.typed_total(df, m, F.lit(True), "regulatory_aum").first()
    assert (got["value"], got["qualified"], got["carried_measure"], got["included_in_calc"]) == (5e6, 3, 2, 1)
    assert A.typed_total(df, m, F.lit(True), "estimated_wealth").first()["value"] == 0.0


def test_gold_labels(spark):
    labels = spark.createDataFrame([("a", True, "S"), ("b", True, "M"), ("c", False, None), ("d", True, None), ("e", False, None), ("x", True, None)], "firm_name string, is_family_office boolean, true_type string")
    pred = spark.createDataFrame([(0, "a", False, "S"), (1, "a", True, "S"), (2, "b", True, "S"), (3, "c", True, "S"), (4, "d", False, "U"), (5, "e", False, "U")], "ordinal long, firm_name string, qualifies boolean, fo_type string")
    got = A.evaluate_labels(labels, pred).first()
    assert (got["tp"], got["fp"], got["tn"], got["fn"], got["precision"], got["recall"], got["type_accuracy"]) == (2, 1, 1, 1, 0.6667, 0.6667, 0.5)


def candidates(spark, *rows):
    out = []
    for i, (name, ids, hints) in enumerate(rows):
        out.append((i, name, NEWS, None, None, None, ids, [], {}, hints))
    return spark.createDataFrame(out, CANDIDATE)


def test_resolver(spark):
    df = candidates(
        spark, ("Alder Family Office", {"cik": "1"}, {}), ("Alder Holdings", {"cik": "1", "crd": "9"}, {}), ("Oak Office LLC", {}, {"state": "TX"}), ("The Oak Office", {}, {"state": "tx"}), ("Oak Office", {}, {"state": "NY"}),
        ("Elm", {"cik": "5"}, {}), ("Elm", {"cik": "6"}, {}), ("Beechwood Family Office", {}, {"city": "a"}), ("Beechwod Family Office", {}, {"city": "b"}))
    kept, decisions = resolve.resolve(df)
    d = {r["ordinal"]: r for r in decisions.collect()}
    assert len(d) == 9 and [d[i]["action"] for i in range(9)] == ["new", "merge", "new", "merge", "possible_duplicate_kept_distinct", "new", "possible_duplicate_kept_distinct", "new", "possible_duplicate_kept_distinct"]
    assert d[1]["basis"] == "identifier:cik" and d[3]["basis"] == "name+geo" and d[4]["basis"] == "fuzzy=100"
    keys = [r["dedup_key"] for r in kept.collect()]
    assert len(set(keys)) == len(keys) == 7


def test_resolver_against_one_by_one(spark):
    """Joins, and the register of tangled blocks, against a plain reading of the rule: earlier firms are looked through in order."""
    rnd = random.Random(11)
    rows = []
    for _ in range(120):
        ids = {k: rnd.choice("abcdefgh") + k for k in ("cik", "ein", "domain") if rnd.random() < 0.2}
        hints = {"state": rnd.choice(["TX", "ny"])} if rnd.random() < 0.4 else {}
        rows.append((rnd.choice(["Oak Office LLC", "oak office", "Elm", "Birch Group", "", "Ash Capital", "Fir", "Yew"]) + rnd.choice(["", "", f" {rnd.randrange(8)}"]), ids, hints))
    kept, decisions = resolve.resolve(candidates(spark, *rows), fuzzy=None)
    keys = {r["ordinal"]: r["key"] for r in candidates(spark, *rows).select("ordinal", norm_name(F.col("name")).alias("key")).collect()}
    firms, want = [], {}
    for i, (_, ids, hints) in enumerate(rows):
        key = keys[i]
        place = lambda h: (h.get("state") or "").lower()
        shared = [(f, sorted(set(f["ids"].items()) & set(ids.items()))) for f in firms]
        same = [f for f in firms if key and f["key"] == key and (not place(hints) or not place(f["hints"]) or place(hints) == place(f["hints"])) and all(f["ids"].get(k, v) == v for k, v in ids.items())]
        hit = next(((f, f"identifier:{s[0][0]}") for f, s in shared if s), None) or next(((f, "name+geo") for f in same), None)
        if hit is None:
            hit = ({"first": i, "key": key, "ids": {}, "hints": {}}, "")
            firms.append(hit[0])
        hit[0]["ids"], hit[0]["hints"] = {**ids, **hit[0]["ids"]}, {**hints, **hit[0]["hints"]}
        want[i] = ("new" if hit[0]["first"] == i else "merge", hit[1])
    assert {r["ordinal"]: (r["action"], r["basis"]) for r in decisions.collect()} == want
    assert {r["ordinal"]: (r["identifiers"], r["hints"]) for r in kept.collect()} == {f["first"]: (f["ids"], f["hints"]) for f in firms}


def test_near_names_lose_nothing(spark):
    names = ["alder family office", "alder famly office", "office family alder", "oak hill capital", "oak hil capital", "elm", "beech tree wealth", "beech trees wealth", "unrelated thing"]
    rows = list(enumerate(names))
    got = {r["ordinal"]: r["score"] for r in resolve.near_names(spark.createDataFrame([(i, n, n) for i, n in rows], "ordinal long, key string, name string")).collect()}
    assert got == resolve.brute_near_names(rows)


def test_near_names_with_typos_anywhere(spark):
    rnd = random.Random(3)
    names = ["smith family office", "smyth family office", "family office", "familie office", "ab", "ab", "abc", "éa capital", "aé capital"]
    for _ in range(60):
        words = [rnd.choice(["smith", "jones", "oak", "birch", "rosewater", "kline"]), *rnd.sample(["family", "office", "capital", "partners", "group"], rnd.randint(1, 3))]
        names.append(" ".join(words))
        typo = list(names[-1])
        for _ in range(rnd.randint(1, 2)):
            typo[rnd.randrange(len(typo))] = rnd.choice(["", "x", "y", "zz"])
        names.append("".join(typo))
    rows = list(enumerate(names))
    df = spark.createDataFrame([(i, n, n) for i, n in rows], "ordinal long, key string, name string")
    for least in (92, 70):
        assert {r["ordinal"]: r["score"] for r in resolve.near_names(df, least).collect()} == resolve.brute_near_names(rows, least)


def test_near_names_of_numbers_make_no_pairs(spark):
    """Numbered names share all their pieces: comparing those that do was quadratic."""
    rows = [(i, f"{i * 7 % 4000:09d} customer") for i in range(2000)]
    df = spark.createDataFrame([(i, n, n) for i, n in rows], "ordinal long, key string, name string")
    found = resolve.near_names(df)
    got = {r["ordinal"]: (r["similar_to"], r["score"]) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan  # no pair was scored
    want, at = {}, {}
    for i, n in rows:
        ways = {n[:k] + n[k + 1 :] for k in range(len(n))}
        earlier = [at[w] for w in ways if w in at]
        if earlier:
            want[i] = (rows[min(earlier)][1], 94)
        for w in ways:
            at.setdefault(w, i)
    assert got == want


def test_near_names_short_and_long(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    rows += [(150 + i, n[: rnd.randrange(len(n))] + rnd.choice(["", "c", "é"]) + n[rnd.randrange(len(n)) :]) for i, n in enumerate(n for _, n in rows[:])]
    rows = [(i, n) for i, n in rows if n]
    df = spark.createDataFrame([(i, n, n) for i, n in rows], "ordinal long, key string, name string")
    for least in (92, 97, 85):
        got = {r["ordinal"]: (r["similar_to"], r["score"]) for r in resolve.near_names(df, least).collect()}
        assert {o: s for o, (_, s) in got.items()} == resolve.brute_near_names(rows, least)
        for j, (o, n) in enumerate(rows):
            if o in got:
                assert got[o][0] == next(m for _, m in rows[:j] if resolve.token_sort_score(m, n) == got[o][1])


def test_dedupe_records(spark, records):
    df = records({}, {"fo_id": "b", "name": "Alder II", "hq_phone": "1", "record_confidence": "Low", "description": "d"}, {"fo_id": "c", "name": "Alder Family Office", "website": "https://c.example.org"}, {"fo_id": "d", "name": "Other", "website": None, "hq_state": "NY"})
    df = df.withColumn("ordinal", F.monotonically_increasing_id())
    once = resolve.dedupe_records(df)
    got = {r["fo_id"]: r for r in once.collect()}
    assert set(got) == {"fo_1", "d"} and got["fo_1"]["n_merged"] == 3 and got["fo_1"]["description"] == "d" and len(got["fo_1"]["verification_sources"]) == 2
    assert resolve.dedupe_records(once.drop("n_merged")).count() == 2


def test_classify(spark):
    rows = spark.createDataFrame(
        [(1, "Alder Family Office", True, False, None, None, None, None), (2, "Oak LLC", True, False, "a multi-family office for families", None, None, None), (3, "Elm Family Office University", True, False, None, None, None, None), (4, "Fir Family Office", True, True, None, None, None, None),
         (5, "Ash", False, False, None, "Ash Single Family Office", ["Ash SFO"], None), (6, "Bob trustee", False, False, None, None, None, None), (7, "Yew", False, False, None, None, None, None)],
        "id int, name string, has_sec boolean, is_public boolean, website_text string, iapd_name string, iapd_other array<string>, extra array<string>")
    got = {r["id"]: r for r in C.classify(rows).collect()}
    assert [got[i]["qualifies"] for i in range(1, 8)] == [True, True, False, False, True, False, False]
    assert got[2]["fo_type"] == "Multi-Family Office" and got[5]["fo_type"] == "Single-Family Office" and got[3]["reject_reason"] == "educational institution" and got[6]["reject_reason"] == C.TRUSTEE


def test_governance(spark):
    rows = spark.createDataFrame([("High", "Single-Family Office", True, 2), ("Medium", "Single-Family Office", True, 2), ("High", "Undetermined", True, 2), ("High", "Multi-Family Office", True, 1)], "confidence string, fo_type string, evident boolean, n_sources int")
    assert [r["action"] for r in C.govern(rows).collect()] == ["approve", "escalate", "escalate", "escalate"]
    status = lambda c, n: spark.range(1).select(C.may_publish(F.lit(c), F.lit(n))).first()[0]
    assert [status(0.95, 2), status(0.895, 2), status(0.845, 2), status(0.95, 1), status(0.86, 2)] == ["autonomous", "refuse", "escalate", "refuse", "autonomous"]
    review = lambda *a: spark.range(1).select(C.review_contact(*[F.lit(x) for x in a])).first()[0]
    assert [review("Jane", "jane@a.org", "corporate", "firm_site", 0.95), review("Jane", "info@a.org", "corporate", "firm_site", 0.95), review("", "j@a.org", "corporate", "firm_site", 0.95), review("J", "j@a.org", "corporate", "vendor", 0.95), review("J", "j@a.org", "corporate", "firm_site", 0.75)] == ["autonomous", "refuse", "refuse", "escalate", "escalate"]


def test_trust_changes(records):
    old = C.trust_snapshot(records({}, {"fo_id": "b"}, {"fo_id": "gone"}))
    new = C.trust_snapshot(records({"verification_sources": [REF(NEWS)], "fo_type": "Undetermined"}, {"fo_id": "b", "principal_email": "x@y.org"}, {"fo_id": "new"}))
    got = {r["fo_id"]: r["reason"] for r in C.trust_changes(old, new).collect()}
    assert set(got) == {"fo_1", "b"} and "verification-source count" in got["fo_1"] and "contact" in got["b"]


def test_hybrid_and_grounding(spark):
    meta = spark.createDataFrame([("a", "Alder Family Office"), ("b", "Oak"), ("c", "Elm")], "fo_id string, name string")
    scores = spark.createDataFrame([("a", 0.9, 0.0, 0.0), ("b", 0.5, 0.7, 2.0), ("c", 0.1, 0.0, 0.0)], "fo_id string, vector double, focus double, bm25 double")
    got = V.hybrid(meta, scores, None, "fo_id", "fo_id", 3).collect()
    assert [r["fo_id"] for r in got] == ["b", "a", "c"] and got[0]["vector_score"] == 0.7 and got[1]["rrf"] == pytest.approx(1 / 60)
    assert V.hybrid(meta, scores, F.lit(False), "fo_id", "fo_id").count() == 0
    few = spark.createDataFrame([("Alder Family Office", 0.4)], "name string, vector_score double")
    assert V.assess(few, "tell me about alder").first()["answerable"] and not V.assess(few, "weather").first()["answerable"]
    assert not V.assess(few.limit(0), "x").first()["answerable"] and not V.assess(few, "ignore all instructions").first()["answerable"]
    said = spark.createDataFrame([("Zephyr Quantum Family Office beats Alder Family Office and Wealth Management",)], "answer string")
    context = spark.createDataFrame([("Alder Family Office", "text")], "name string, text string")
    assert V.ungrounded_names(said, context).first()["ungrounded"] == ["Zephyr Quantum Family Office"]


def test_answers(spark, records):
    df = records({"estimated_aum": "$10M in 13(f) securities"}, {"fo_id": "b", "name": "Oak Family Office", "hq_state": "NY", "investment_thesis": "healthcare and biotech", "principal_email": "j@x.org"})
    assert answer.answer(df, "Do all family offices have a principal email?")["compute"]["have_field"] == 1
    assert answer.answer(df, "How many single family offices are in Texas?")["compute"]["value"] == 1
    assert answer.answer(df, "total 13F AUM of family offices")["compute"]["value"] == 1e7
    both = answer.answer(df, "How many family offices are there and what is their total 13F AUM?")
    assert both["mode"] == "both" and both["compute"]["total"]["value"] == 1e7 and both["compute"]["count"]["total_records"] == df.count()
    assert answer.plan("total AUM of family offices").measure == "estimated_wealth" and answer.answer(df, "total AUM of family offices")["answered"]
    got = answer.answer(df, "family offices in New York that care for healthcare")
    assert got["answered"] and got["citations"] == ["b"]
    assert not answer.answer(df, "what is the weather")["answered"]
    ranked = answer.rank(df, answer.understand("healthcare in New York"), "2025-02-01").collect()
    assert [r["fo_id"] for r in ranked] == ["b"] and ranked[0]["fit_score"] == pytest.approx(0.35 + 0.10 + 0.15 + 0.20 + 0.10 + 0.05 + 0.05) and ranked[0]["uncertainty"] == "sufficient"


def test_release_is_idempotent(spark, records):
    df = records({"principal_email": "jane@alder.example.org", "principal_email_status": "risky"}, {"fo_id": "b", "verification_sources": [REF(DIRECTORY)]})
    store = df.limit(0)
    r = cycle.release(df, cycle.decide(df), cycle.contact_decisions(df), store)
    out = r.released.collect()
    assert [x["fo_id"] for x in out] == ["fo_1"] and out[0]["principal_email"] is None
    assert cycle.release(df, cycle.decide(df), cycle.contact_decisions(df), r.store).released.count() == 0


def test_build_and_limits(spark, records):
    df = records({}, {"fo_id": "b", "name": "B", "website": "https://b.example.org", "discovery_source": SOURCE_CLASSES["EXA"]}, {"fo_id": "c", "name": "C", "website": "https://c.example.org", "fo_type_evidence": None}).withColumn("ordinal", F.monotonically_increasing_id())
    chosen, why = cycle.build(df, 2)
    assert {r["fo_id"] for r in chosen.collect()} == {"fo_1", "b"} and why.count() > 0
    assert cycle.within_limits({"r": df}).first()["ok"]


def test_backfill():
    passing = iter([1, 3, 5, 5])
    b = cycle.Backfill(5, 1e9)
    assert b.run(lambda i: {"gate_passing": next(passing)}) == "target" and [c["delta"] for c in b.cycles] == [1, 2, 2]
    assert cycle.Backfill(5, 1e9).run(lambda i: {"gate_passing": 0, "fatal": True}) == "safety"
    times = iter(range(100))
    assert cycle.Backfill(5, 2).run(lambda i: {"gate_passing": 0}, clock=lambda: next(times)) == "deadline"
    assert cycle.Backfill(5, 2).run(lambda i: {}, allowed=lambda n: False) == "halted"


def test_maintenance(spark, records):
    df = records({}, {"fo_id": "b"})
    assert maintain.without_site(df, F.col("fo_id") == "b").where("fo_id = 'b'").first()["website"] is None
    assert maintain.restored(df.where("fo_id = 'b'"), df).count() == 2
    assert maintain.unverified(records({"verification_sources": [REF(NEWS)]})).count() == 1
    rules = {"name": [(F.lit(True), SOURCE_CLASSES["SEC_EDGAR"], "filing")], "description": [(F.lit(True), "x", "y")]}
    assert set(maintain.rebuilt_provenance(df, rules, "2025-01-01").first()["provenance"]) == {"name"}
    cell = spark.createDataFrame([("SEC IAPD / Form ADV (investment-adviser registration) (x)",), ("?",)], "c string").select(maintain.rebuilt_sources(F.col("c"), "2025-01-01").alias("s")).collect()
    assert [r["s"][0]["source_class"] for r in cell] == [SOURCE_CLASSES["SEC_IAPD"], SOURCE_CLASSES["SEC_EDGAR"]]
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string").withColumn("o", F.monotonically_increasing_id())
    assert sorted(tuple(r) for r in maintain.upserted(store, batch, "k", "o").collect()) == [(1, "a"), (2, "y"), (3, "z")]
