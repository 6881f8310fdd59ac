from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import documents as J
from ledgerlake.functions import markup as H
from ledgerlake.functions import measures as M
from ledgerlake.functions import text as X


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "key"), [("The Smith Family Office, L.L.C.", "smith family office"), ("Blue Capital", "blue capital"), ("Müller & Co. KG", "m ller kg"), ("", "")])
def test_norm_name(spark, name, key):
    assert one(spark, X.norm_name(F.lit(name))) == key


def test_broad_suffixes(spark):
    assert one(spark, X.norm_name(F.lit("Blue Capital Partners LLC"), X.BROAD_SUFFIXES)) == "blue"


def test_small_text_functions(spark):
    assert one(spark, X.phone(F.lit("(555) 010-2030"))) == "+1 (555) 010-2030"
    assert one(spark, X.phone(F.lit("1-555-010-2030"))) == "+1 (555) 010-2030"
    assert one(spark, X.phone(F.lit(" +44 20 7 "))) == "+44 20 7"
    assert one(spark, X.phone(F.lit(""))) is None
    assert one(spark, X.ein(F.lit("123456789"))) == "12-3456789"
    assert one(spark, X.ein(F.lit("000000000"))) is None
    assert one(spark, X.title_case_upper(F.lit("MERCK & Co INC"))) == "Merck & Co Inc"
    assert one(spark, X.first_last(F.lit("ROE, JANE"))) == "Jane Roe"
    assert one(spark, X.without_cik(F.lit("Alder LLC (CIK 0001)"))) == "Alder LLC"
    assert one(spark, X.host(F.lit("HTTPS://www.Alder.example.com/x?y"))) == "alder.example.com"
    assert one(spark, X.host(F.lit("alder.example.com"))) == ""
    assert one(spark, X.norm_website(F.lit("https://www.a.example.com/b/"))) == "a.example.com/b"
    assert one(spark, X.identity_tokens(F.lit("The Alder Family Office LLC"))) == ["alder"]
    assert one(spark, X.name_core(F.lit("Alder Family Office, LLC"))) == "alder"
    assert one(spark, X.entity_id(F.lit("a"))) == "fo_ca978112ca"
    assert one(spark, X.likely_domains(F.lit("Alder Family Office"))) == ["alderfamilyoffice.com", "alderfo.com", "alder-family-office.com"]
    assert one(spark, X.without_thinking(F.lit("<think>no</think> yes"))) == "yes"
    assert one(spark, X.generic_mailbox(F.lit("Info@x.example.com"))) is True


def test_names_and_people(spark):
    assert one(spark, X.office_names(F.lit("The Alder Family Office and Best New Oak Hill Family Office met a Family Office"))) == ["Alder Family Office", "Oak Hill Family Office"]
    assert one(spark, X.same_person(F.lit("Jane A. Roe, CFA"), F.lit("jane roe"))) is True
    assert one(spark, X.same_person(F.lit("Jane Roe"), F.lit(None).cast("string"))) is False
    assert one(spark, X.name_shaped(F.lit("Jane Roe"))) is True
    assert one(spark, X.name_shaped(F.lit("Compliance Officer"))) is False
    assert one(spark, X.mentions_name(F.lit("met Jane A. B. Roe today"), F.lit("Jane Roe"))) is True
    assert one(spark, X.mentions_name(F.lit("met Jane one two three Roe"), F.lit("Jane Roe"))) is False


def test_mailboxes(spark):
    text = "jane@alder.example.org info@alder.example.org x@other.org noreply@alder.example.org JANE@alder.example.org a@b.png"
    own = one(spark, X.own_emails(F.lit(text), F.lit("https://alder.example.org/about")))
    assert own == []  # "example" in a domain is junk
    text = text.replace("example", "sample")
    assert one(spark, X.own_emails(F.lit(text), F.lit("https://alder.sample.org"))) == ["info@alder.sample.org", "jane@alder.sample.org"]
    assert one(spark, X.company_profile(F.lit("linkedin.com/company/jobs linkedin.com/company/alder-x"))) == "https://www.linkedin.com/company/alder-x"


def test_mailboxes_of_texts_are_all_counted(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["rtestn.5@mail5.example.com", ".a.b@x.example.org a.b@x.example.org A.B@x.example.org", "noreply@x.org", "x@y.zz a@b.png", "none", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["own_mailboxes"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(db.execute(entry.oracle_sql()["own_mailboxes"]).fetchall())
    assert dict(got) == {0: 1, 1: 2, 2: 1, 3: 2}


def test_thesis(spark):
    good = "We invest with a long-term approach to preserve wealth for each generation of the family."
    assert one(spark, X.thesis(F.lit("Home About Team Contact. " + good + " Read our privacy policy."))) == good
    assert one(spark, X.thesis(F.lit("Home About Team Contact"))) is None


def test_similarity(spark):
    assert X.token_sort_score("smith family office", "office smith family") == 100
    assert X.token_sort_score("abcd", "abce") == 75
    assert X.token_set_score("alder capital", "alder capital group") == 100.0
    rows = spark.createDataFrame([("a b", "b a"), ("abcd", "abce")], "a string, b string")
    assert [r[0] for r in rows.select(X.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100, 75]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$228.5M in 13(f) securities as of 03-31-2026", (228.5e6, "13F_securities_value", None, "SEC Form 13F")),
        ("$2.48B total regulatory AUM (SEC Form ADV Item 5.F as of 2024)", (2.48e9, "regulatory_aum", "2024", "SEC Form ADV")),
        ("$5 million", (5e6, "unknown", None, None)), ("$1,234", (1234.0, "unknown", None, None)), ("undisclosed", None), ("", None), (None, None),
    ],
)
def test_parse_aum(spark, text, want):
    got = one(spark, M.parse_aum(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def test_money_and_dates(spark):
    assert one(spark, M.parse_aum_usd(F.lit("$5 bonds"))) == 5_000_000_000
    assert one(spark, M.sortable_aum(F.lit("none"))) == -1
    assert one(spark, M.human_usd(F.lit(2.48e9))) == "$2.48B"
    assert one(spark, M.human_usd(F.lit(228.5e6))) == "$228.5M"
    assert one(spark, M.human_usd(F.lit(1234))) == "$1,234"
    assert one(spark, M.period_date(F.lit("03-31-2026"))) == date(2026, 3, 31)
    assert one(spark, M.period_date(F.lit("13-31-2026"))) is None
    assert one(spark, M.seen_date(F.lit("20260101T000000Z"))) == date(2026, 1, 1)
    assert one(spark, M.iso_date(F.lit("x"), F.lit("2025-01-01").cast("date"))) == date(2025, 1, 1)
    assert one(spark, M.days_since(F.lit("2024-12-31"), F.lit("2025-01-01").cast("date"))) == 1
    assert one(spark, M.filing_year(F.lit("1/2/2024"))) == 2024
    assert M.cron_hours("*/2") == list(range(0, 24, 2)) and M.is_every_two_hours("*/2") and not M.is_every_two_hours("1,2")
    assert M.planned_cycles(2, 30) == 3 and M.planned_cycles(0, 30) == 1


@pytest.mark.parametrize(("c", "band"), [(0.95, "auto_release"), (0.895, "quarantine"), (0.86, "auto_release_medium"), (0.845, "quarantine"), (0.8, "hold_governance_review"), (0.1, "quarantine")])
def test_bands_keep_their_gaps(spark, c, band):
    assert one(spark, M.release_band(F.lit(c))) == band


@pytest.mark.parametrize(("v", "score"), [("High", 0.9), ("low", 0.3), ("85", 0.85), ("0.7", 0.7), ("odd", 0.3)])
def test_confidence_score(spark, v, score):
    assert one(spark, M.confidence_score(F.lit(v))) == pytest.approx(score)


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, M.cosine(a, F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
    assert one(spark, M.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


PAGE = """<html><head><meta property="og:description" content="og"><meta name="description" content="About us"><style>p{}</style></head><body><nav>Home</nav>
<div><div class=card><h3>Jane Roe</h3><p>Managing Partner</p><a href="mailto:jane@alder.sample.org?x=1">mail</a></div><div class=card><h3>John Doe</h3><p>Founder</p><a href="mailto:info@alder.sample.org">mail</a></div></div>
<script>var a = "</p> no";</script><footer>end</footer></body></html>"""


def test_html(spark):
    got = spark.createDataFrame([(PAGE,), (None,)], "h string").select(H.page_facts(F.col("h")).alias("p")).select("p.*").collect()
    assert got[0]["description"] == "About us" and "Jane Roe Managing Partner" in got[0]["text"] and "no" not in got[0]["text"].split()
    assert got[0]["mailto"] == ["jane@alder.sample.org", "info@alder.sample.org"] and got[1]["text"] == ""
    team = "<div><li>Jane A. Roe, CFA jane@alder.sample.org x@other.org <a href='https://linkedin.com/in/jane-roe/?x'>in</a></li><li>John Doe</li></div>"
    assert H.person_card(team, "Jane Roe", "alder.sample.org") == ("jane@alder.sample.org", "https://www.linkedin.com/in/jane-roe")
    assert H.person_card(team, "Mary Major", "alder.sample.org") == (None, None)
    people = {p["name"]: p for p in H.page_people(PAGE, "alder.sample.org")}
    assert people["Jane Roe"]["verdict"] == "verified_decision_maker" and people["John Doe"]["verdict"] == "possible_decision_maker"
    rows = spark.createDataFrame([(PAGE.replace(">mail<", ">jane@alder.sample.org<", 1), "Jane Roe", "alder.sample.org")], "h string, n string, o string")
    assert rows.select(H.matched_contact("h", "n", "o").alias("c")).first()["c"]["email"] == "jane@alder.sample.org"
    assert len(rows.select(F.explode(H.people("h", "o"))).collect()) == 2


TEAM = """<html><head><title>Team</title></head><body><header><h2>Mary Header</h2><p>Founder</p></header><div class="grid">
<div><h3>Ida Berg</h3><p>Founder and Chief Investment Officer.</p><a href="mailto:ida@oak.example.com?subject=x">Write</a></div>
<div><h3><strong>Omar Lund</strong></h3><p>Managing Partner for direct deals.</p><a href="mailto:info@oak.example.com">inbox</a></div>
<div><h3>Ana Costa</h3><p>Head of Operations.</p></div>
<div><b>Li Wen</b><span>Trustee</span><a href="https://www.linkedin.com/in/li-wen_9/?a">in</a></div>
<div><h4>Ida Berg</h4><p>President</p></div></div>
<p>Compliance Officer Mr. Tim Kahn answers.</p><footer><h3>Foot Er</h3><p>Partner</p></footer></body></html>"""


def test_page_people():
    got = {p["name"]: p for p in H.page_people(TEAM)}
    assert set(got) == {"Ida Berg", "Omar Lund", "Li Wen"}
    assert (got["Ida Berg"]["title"], got["Ida Berg"]["email"], got["Ida Berg"]["verdict"]) == ("Founder", "ida@oak.example.com", "verified_decision_maker")
    assert (got["Omar Lund"]["title"], got["Omar Lund"]["email"], got["Omar Lund"]["verdict"]) == ("Managing Partner", None, "possible_decision_maker")
    assert got["Li Wen"]["linkedin"] == "https://www.linkedin.com/in/li-wen_9"
    assert H.page_people("") == H.page_people(None) == H.page_people("<p>Welcome.") == []
    assert H.page_people("<div><h3>Ann Lee</h3>Partner<h3>Bo Ray</h3></div>")[0]["block_text"] == "Ann Lee Partner Bo Ray"


XML = "<ns:informationTable><ns:infoTable><ns:nameOfIssuer>A &amp; B</ns:nameOfIssuer><ns:value>10</ns:value></ns:infoTable><ns:infoTable><ns:nameOfIssuer>C</ns:nameOfIssuer><ns:value>1,000</ns:value></ns:infoTable></ns:informationTable>"


def test_xml(spark):
    assert [tuple(r) for r in one(spark, H.holdings(F.lit(XML)))] == [("A & B", 10), ("C", 1000)]
    assert one(spark, H.top_holdings(F.lit(XML), 1)) == ["C"]
    assert one(spark, H.xml_tag(F.lit(XML), "missing")) is None


def test_json(spark):
    payload = '{"name": "A", "phone": "5550102030", "ein": "123456789", "tickers": [], "exchanges": [null], "addresses": {"business": {"city": "X"}}, "filings": {"recent": {"form": ["13F-HR", "4", "13F-HR/A"], "accessionNumber": ["1", "2", "3"], "filingDate": ["a", "b", "c"]}}}'
    got = one(spark, J.registry_facts(F.lit(payload)))
    assert (got["legal_name"], got["ein"], got["is_public"], got["city"]) == ("A", "12-3456789", False, "X")
    recent = F.from_json(F.lit(payload), J.SUBMISSION).filings.recent
    assert [r["accession"] for r in one(spark, J.filings(recent))] == ["1", "3"]
    assert one(spark, J.json_block(F.lit('text ```json\n{"a": 1}\n``` more'))).strip() == '{"a": 1}'
    assert one(spark, J.json_block(F.lit("none {bad"))) is None
    assert one(spark, J.nested_address(F.lit('{"officeAddress": {"city": "X"}}')))["city"] == "X"
