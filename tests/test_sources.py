import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

import pytest

from ledgerlake.operators.records import delivery
from ledgerlake.schemas import AUDIT, SOURCE_CLASSES
from ledgerlake.sources import readers, recorded, sinks
from ledgerlake.streaming import events as S


def test_export_and_read_again(spark, records, tmp_path):
    df = records({"description": 'say "x", y', "principal_email": "j@x.org"}, {"fo_id": "b"})
    counts = sinks.export(df, spark.createDataFrame([], AUDIT), str(tmp_path / "out"))
    assert counts == {"dataset": 2, "provenance": 20, "sources": 6, "audit": 0, "dictionary": 49}
    back = readers.delivered(spark, str(tmp_path / "out/dataset"), "2025-01-01")
    row = back.where("fo_id = 'fo_1'").first()
    assert row["description"] == 'say "x", y' and row["principal_email"] == "j@x.org" and len(row["verification_sources"]) == 2 and row["signals"][0]["text"] == "bought shares"
    assert readers.delivered(spark, str(tmp_path / "out/dataset"), "2025-01-01", False).where("principal_email IS NOT NULL").count() == 0
    assert delivery(back).count() == 2 and readers.qualifying(back).count() == 2


def test_leads(spark, tmp_path):
    lines = ['{"candidate_name": "Alder  Office", "country": "X"}', "", "{bad", '{"country": "Y"}', '{"candidate_name": "alder office"}', '{"candidate_name": "Oak"}']
    (tmp_path / "cycle1_usa.jsonl").write_text("\n".join(lines))
    got, counts = readers.consolidated(spark, str(tmp_path / "*.jsonl"))
    assert {r["candidate_name"]: r["cycle"] for r in got.collect()} == {"Alder  Office": "cycle1_usa", "Oak": "cycle1_usa"}
    assert tuple(counts.first()) == (5, 1, 1)
    assert readers.leads(spark, str(tmp_path / "*.jsonl")).count() == 3
    (tmp_path / "gold.txt").write_text('# c\n{"firm_name": "A", "is_family_office": true}\n')
    assert readers.gold_labels(spark, str(tmp_path / "gold.txt")).first()["firm_name"] == "A"
    (tmp_path / "facts.json").write_text('{"1": {"a": 2}, "3": {}}')
    assert {r["key"]: r["a"] for r in readers.lookup(spark, str(tmp_path / "facts.json"), "a:int").collect()} == {"1": 2, "3": None}


def test_bulk(spark, tmp_path):
    import zipfile

    (tmp_path / "adv.csv").write_bytes('"CRD","Näme"\n"1","Älder"\n'.encode("latin-1"))
    assert tuple(readers.adviser_filings(spark, str(tmp_path / "adv.csv"), {"CRD": "crd", "Näme": "name"}).first()) == ("1", "Älder")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "l1\nl2\n")
    assert [r["line"] for r in readers.zipped_text(spark, str(tmp_path / "a.zip")).collect()] == ["l1", "l2"]


def test_recorded(spark, tmp_path):
    page = {"hits": {"hits": [{"_source": {"display_names": ["Alder LLC (CIK 7)"], "ciks": ["7"], "biz_states": ["TX"]}}, {"_source": {"display_names": ["Alder again"], "ciks": ["7"]}}]}}
    (tmp_path / "p0.json").write_text(json.dumps(page))
    got = recorded.discover(spark, "edgar", [str(tmp_path / "p0.json"), str(tmp_path / "none.json")], missing="skip").collect()
    with pytest.raises(FileNotFoundError):
        recorded.discover(spark, "edgar", [str(tmp_path / "none.json")])
    assert recorded.discover(spark, "edgar", [], missing="skip").count() == 0
    spark.dataSource.register(recorded.Recorded)
    assert spark.read.format("recorded").option("kind", "edgar").option("paths", str(tmp_path / "p0.json")).load().count() == 2
    assert len(got) == 1 and got[0]["name"] == "Alder LLC" and got[0]["hints"] == {"state": "TX"} and got[0]["source_class"] == SOURCE_CLASSES["SEC_EDGAR"]
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"title": "The Alder Family Office buys"}, {"title": "Oak Family Office and Alder Family Office"}]}))
    names = recorded.discover(spark, "news", [str(tmp_path / "n.json")])
    assert {r["name"] for r in names.collect()} == {"Alder Family Office", "Oak Family Office"} and recorded.discover(spark, "news", [str(tmp_path / "n.json")], 1).count() == 1


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 3)], "o long, k string, v int")
    named = spark.createDataFrame([(0, "Oak LLC", "x"), (1, "The Oak", None), (2, "oak, inc", ""), (3, "Elm", "x")], "o long, name string, dedup_key string")
    pool = str(tmp_path / "named")
    assert sinks.insert_candidates(named, pool, "o") == 2 and sinks.insert_candidates(named, pool, "o") == 0
    assert {(r["name"], r["dedup_key"]) for r in spark.read.parquet(pool).collect()} == {("Oak LLC", "x"), ("The Oak", "oak")}
    folder = str(tmp_path / "pool")
    assert sinks.insert_new(rows, folder, "k", "o") == 2 and sinks.insert_new(rows, folder, "k", "o") == 0
    assert {r["v"] for r in spark.read.parquet(folder).collect()} == {1, 3}
    store = str(tmp_path / "store")
    assert sinks.read_current(spark, store) is None
    sinks.upsert(rows, store, "k", "o", "v1")
    sinks.upsert(rows.where("k = 'b'").withColumn("v", F.lit(9)), store, "k", "o", "v2")
    assert {r["k"]: r["v"] for r in sinks.read_current(spark, store).collect()} == {"a": 2, "b": 9}
    assert sinks.snapshots(spark.createDataFrame([("x",), ("x",)], "content string"), str(tmp_path / "snap")) == 1
    run = sinks.manifest(spark, str(tmp_path / "m.json"), "build", {"n": 1}, {"schema": "1"}, datetime(2025, 1, 1, tzinfo=timezone.utc))
    assert json.loads((tmp_path / "m.json").read_text())["counts"] == {"n": 1} and run["run_id"] == "build-20250101T000000Z"
    sinks.export_pool(rows.withColumnRenamed("k", "dedup_key"), str(tmp_path / "pool_json"))
    assert spark.read.json(str(tmp_path / "pool_json")).count() == 3


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(source))
    stream = S.sliding(S.read_events(spark, str(source), 1), late="10000 days")
    out, seen = str(tmp_path / "out"), []
    S.each_batch(stream, lambda df, n: (df.write.mode("overwrite").parquet(f"{out}/{n}"), seen.append(n)), str(tmp_path / "c"), "complete")
    last = spark.read.parquet(f"{out}/{max(seen)}")
    want = S.sliding(spark.read.parquet(str(source)))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect())) and len(seen) >= 3
    S.each_batch(stream, lambda df, n: seen.append(-1), str(tmp_path / "c"), "complete")
    assert -1 not in seen  # nothing new, nothing done again
    S.run_once(S.distinct_events(S.read_events(spark, str(source))), str(tmp_path / "d"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == spark.read.parquet(str(source)).count()
    assert S.sessions(spark.read.parquet(str(source))).agg(F.sum("n")).first()[0] == spark.read.parquet(str(source)).count()


@pytest.mark.parametrize("audited", [0, 2])
def test_export_counts_what_it_writes(spark, records, tmp_path, audited):
    from ledgerlake.schemas import AUDIT

    audit = spark.createDataFrame([(f"fo_{i}", "website", "x", "r", "s", None) for i in range(audited)], AUDIT)
    counts = sinks.export(records({}, {"fo_id": "b"}), audit, str(tmp_path))
    read = lambda name: spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / name)).count()
    assert counts["dataset"] == 2 and counts["audit"] == audited and counts["provenance"] > 2
    assert {name: read(name) for name in counts if counts[name]} == {name: n for name, n in counts.items() if n}


def test_pages_followed_once(spark, tmp_path):
    """Pages that come later, one that repeats an earlier name, a run that finds nothing new."""
    page = lambda *names: json.dumps({"organizations": [{"name": n, "ein": e} for n, e in names]})
    (tmp_path / "pages").mkdir()
    run = lambda: recorded.follow(spark, "nonprofit", *(str(tmp_path / x) for x in ("pages", "store", "log")))
    said = lambda: sorted((r["key"], r["name"]) for r in spark.read.parquet(str(tmp_path / "store")).collect())
    (tmp_path / "pages" / "a.json").write_text(page(("Oak", 1), ("Elm", 2), (None, 3), ("Oak again", 1)))
    run()
    assert said() == [("nonprofit:1", "Oak"), ("nonprofit:2", "Elm")]
    (tmp_path / "pages" / "b.json").write_text(page(("Elm of old", 2), ("Ash", 4)))
    run()
    run()
    assert said() == [("nonprofit:1", "Oak"), ("nonprofit:2", "Elm"), ("nonprofit:4", "Ash")]


def test_people_as_a_table(spark):
    from ledgerlake.functions import markup

    two = "<div><h3>Ida Berg</h3>Founder <a href='mailto:ida@oak.example'>x</a></div><div><h3>Li Wen</h3>Trustee</div>"
    pages = spark.createDataFrame([(1, two), (2, ""), (3, None), (4, "<p>nobody"), (5, two)], "page_id int, html string")
    rows = markup.with_people(pages)
    got = sorted((r["page_id"], r["place"], r["name"], r["email"]) for r in rows.collect())
    assert got == [(i, *p) for i in (1, 5) for p in ((0, "Ida Berg", "ida@oak.example"), (1, "Li Wen", None))]
    assert "ArrowEvalPythonUDTF" in rows._jdf.queryExecution().toString() and "html" not in rows.columns
    one_by_one = markup.page_people(two)
    assert [r["title"] for r in rows.where("page_id = 1").orderBy("place").collect()] == [p["title"] for p in one_by_one]
    assert markup.with_people(pages.limit(0)).count() == 0
    spark.udtf.register("people_of", markup.PeopleOf)
    pages.createOrReplaceTempView("team_pages")
    assert spark.sql("SELECT page_id, name FROM team_pages, LATERAL people_of(html, '')").count() == 4


def test_packed_pages_followed_once(spark, tmp_path):
    """Pages as rows of few files: the first page by name counts, a later file adds what is new, a restart nothing; rows without a page or content say nothing."""
    page = lambda *names: json.dumps({"organizations": [{"name": n, "ein": e} for n, e in names]})
    put = lambda *rows: spark.createDataFrame(rows, "page string, content string").coalesce(1).write.mode("append").json(str(tmp_path / "pages"))
    run = lambda: recorded.follow(spark, "nonprofit", *(str(tmp_path / x) for x in ("pages", "store", "log")), packed=True)
    said = lambda: sorted((r["key"], r["name"], r["page"]) for r in spark.read.parquet(str(tmp_path / "store")).collect())
    put(("2", page(("Elm", 2), ("Late Oak", 1))), ("1", page(("Oak", 1))), (None, page(("No", 9))), ("3", None))
    run()
    assert said() == [("nonprofit:1", "Oak", "1"), ("nonprofit:2", "Elm", "2")]
    put(("0", page(("Elm of old", 2), ("Ash", 4))))
    run()
    run()
    assert said() == [("nonprofit:1", "Oak", "1"), ("nonprofit:2", "Elm", "2"), ("nonprofit:4", "Ash", "0")]


def test_discovered_stream_writes_few_files(spark, tmp_path, monkeypatch):
    """The files of recorded pages do not grow with the pages, of which there are 18,000 of each kind for 900,000 customers."""
    from pathlib import Path

    from ledgerlake.plans import file_library, library

    monkeypatch.setattr(file_library, "scratch", lambda spark: str(tmp_path / "files"))
    k = spark.range(4000)
    k.selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "'BUILDING' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    assert library.QUERIES["discovered_stream"](spark, str(tmp_path)).count() == 2000 + 2666 + 3200 + 2000 + 1 + 1
    assert len([*Path(tmp_path / "files" / "edgar").rglob("part-*")]) < 80 / 2
