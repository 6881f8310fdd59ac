"""What grows batch by batch: entities, and trust as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import classify
from ledgerlake.schemas import TRUST_FIELDS
from ledgerlake.sources import entities, sinks
from ledgerlake.streaming import trust


@pytest.mark.parametrize("seed", [1, 2])
def test_entities_batch_by_batch(spark, tmp_path, seed):
    """Batches in any order of ids; chains that make old entities meet, more than once."""
    rnd = random.Random(seed)
    rows = [(i, [f"k{rnd.randrange(70)}" for _ in range(rnd.randint(0, 3))]) for i in range(90)] + [(90, None), (91, ["alone"])]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_key, moved, seen = {}, 0, []
    order = rows[:]
    rnd.shuffle(order)
    for batch, at in enumerate(range(0, len(order), 25)):
        part = order[at : at + 25]
        seen += [i for i, ks in part if ks]
        for i, ks in part:
            for k in ks or ():
                a, b = sorted((find(i), find(by_key.setdefault(k, i))))
                parent[b] = a
        df = spark.createDataFrame(part, "ordinal long, ids array<string>")
        moved += entities.extend(df, str(tmp_path), batch)
        assert entities.extend(df, str(tmp_path), batch) == 0
        assert {r["id"]: r["root"] for r in entities.current(spark, str(tmp_path)).collect()} == {i: find(i) for i in seen}
    assert moved > 0


def test_a_batch_that_broke_off(spark, tmp_path):
    """Without the pointer a batch's files count for nothing, and the batch is done again."""
    batch = lambda *rows: spark.createDataFrame(rows, "ordinal long, ids array<string>")
    entities.extend(batch((5, ["a"]), (6, ["b"])), str(tmp_path), 0)
    entities.extend(batch((1, ["a", "b"])), str(tmp_path), 1)
    sinks.put_pointer(spark, str(tmp_path), "0")
    assert {r["id"]: r["root"] for r in entities.current(spark, str(tmp_path)).collect()} == {5: 5, 6: 6}
    entities.extend(batch((2, ["b"])), str(tmp_path), 1)
    assert {r["id"]: r["root"] for r in entities.current(spark, str(tmp_path)).collect()} == {2: 2, 5: 5, 6: 2}


def drop(spark, rows):
    empty = {f: None for f in TRUST_FIELDS}
    full = [(i, *(empty | changes).values(), n, cycle) for i, cycle, n, changes in rows]
    return spark.createDataFrame(full, trust.DROP)


def test_trust_as_a_stream(spark, tmp_path):
    """Drop by drop, two drops in one run, a firm that stays away for a cycle, a cycle that comes late, a run without news."""
    a, b, c = ({"fo_type": t, "principal_email": e} for t, e in (("S", "x"), ("S", "y"), ("M", "y")))
    drops = [
        [("f1", 0, 2, a), ("f2", 0, 2, a), ("f3", 0, 1, a), ("", 0, 1, a), (None, 0, 1, a)],
        [("f1", 1, 1, a), ("f2", 1, 2, b)],
        [("f1", 2, 1, a), ("f2", 2, 2, c), ("f3", 2, 0, c), ("f4", 2, 0, c)],
        [("f1", 1, 9, c), ("f4", 3, 0, a), ("f4", 3, 7, b)],
    ]
    run = lambda: trust.follow(spark, *(str(tmp_path / x) for x in ("drops", "changes", "checkpoint")))
    for i, rows in enumerate(drops):
        drop(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "drops"))
        if i != 1:
            run()
    run()
    got = {(r["fo_id"], r["cycle"]): (r["reason"], [tuple(x) for x in r["changed"]]) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert set(got) == {("f1", 1), ("f2", 1), ("f2", 2), ("f4", 3)}
    for before, after in ((0, 1), (1, 2)):
        ids = [r[0] for r in drops[after]]
        now, was = (drop(spark, [r for r in drops[x] if r[0] in ids]).drop("cycle") for x in (after, before))
        want = {(r["fo_id"], after): (r["reason"], [tuple(x) for x in r["changed"]]) for r in classify.trust_changes(was, now).collect()}
        assert {k: v for k, v in got.items() if k[1] == after} == want
    assert got["f4", 3][1] == [("fo_type", "M", "S"), ("principal_email", "y", "x")]


def test_trust_batch_that_broke_off(spark, tmp_path):
    """Without its version in the state's pointer a batch is done again and gives the same; done twice, it changes nothing. No Python runs for each firm."""
    target, state = str(tmp_path / "changes"), str(tmp_path / "state")
    at = lambda *rows: drop(spark, list(rows)).withColumn("place", F.monotonically_increasing_id())
    trust.advance(at(("f1", 0, 2, {"fo_type": "S"}), ("f2", 0, 2, {})), 0, target, state)
    for undone in (False, True, False):
        if undone:
            sinks.put_pointer(spark, state, "v0")
        trust.advance(at(("f1", 1, 1, {"fo_type": "M"}), ("f3", 1, 1, {})), 1, target, state)
        got = spark.read.parquet(target).select("fo_id", "cycle", F.col("changed.field").alias("f")).collect()
        assert [tuple(r) for r in got] == [("f1", 1, ["fo_type", "n_sources"])]
    trust.advance(at(("f1", 2, 1, {"fo_type": "M"}), ("f2", 2, 0, {}), ("f3", 2, None, {})), 2, target, state)
    assert sorted((r["fo_id"], r["cycle"]) for r in spark.read.parquet(target).collect()) == [("f1", 1), ("f3", 2)]
    plan = trust.changes(trust.against_last(at(("f1", 0, 2, {})), None))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_trust_reason_orders(spark):
    rows = spark.createDataFrame([([("principal_phone", "a", "b"), ("record_confidence", "a", "b")],), ([("estimated_aum", None, "1")],)], "changed array<struct<field:string,was:string,now:string>>")
    assert [r[0].split()[0] for r in rows.select(classify.trust_reason(F.lit(False))).collect()] == ["record", "a"]


def test_citations_follow_the_lines(spark):
    from ledgerlake.operators import retrieve

    rows = [(f"fo_{i}", f"Firm {i}", "S", "", "", "x", None, 100 - i) for i in range(40)]
    cards = spark.createDataFrame(rows, "fo_id string, name string, fo_type string, hq_city string, hq_state string, hq_country string, aum string, place long").repartition(7)
    out = retrieve.extractive(cards).first()
    assert out["citations"] == [f"fo_{i}" for i in reversed(range(40))]
    assert [x.split()[2] for x in out["answer"].split("\n")] == [str(i) for i in reversed(range(40))]
