import random

from pyspark.sql import functions as F

from ledgerlake.operators import relations as R


def brute_balanced(rows, target, share):
    cap, by = max(1, int(share * target)), {}
    for o, s, q in rows:
        by.setdefault(s, []).append((o, s, q))
    for s in by:
        by[s].sort(key=lambda r: (-r[2], r[0]))
    out, counts = [], dict.fromkeys(by, 0)
    while len(out) < target:
        took = False
        for s in by:
            if counts[s] < min(cap, len(by[s])) and len(out) < target:
                out.append(by[s][counts[s]])
                counts[s] += 1
                took = True
        if not took:
            break
    seen = {s: min(o for o, t, _ in rows if t == s) for s in by}
    rest = sorted((r for s in by for r in by[s][counts[s] :]), key=lambda r: (-r[2], seen[r[1]], by[r[1]].index(r)))
    return {r[0] for r in out + rest[: target - len(out)]}


def test_balanced(spark):
    rnd = random.Random(3)
    for target in (3, 10, 30):
        rows = [(i, rnd.choice("aaaaabc"), rnd.randint(0, 5)) for i in range(25)]
        df = spark.createDataFrame(rows, "o long, s string, q int")
        got = R.balanced(df, "s", [F.desc("q")], "o", target).collect()
        assert {r["o"] for r in got} == brute_balanced(rows, target, 0.4) and len(got) == min(target, 25)


def test_first_wins_and_new(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, "c", None), (4, "d", None)], "o long, n string, s string")
    there = spark.createDataFrame([("c", "q")], "n string, s string")
    assert sorted(r["o"] for r in R.net_new(df, there, "n", "s", order="o").collect()) == [0, 4]
    assert sorted(r["o"] for r in R.first_wins(df, ["n"], ["o"]).collect()) == [0, 1, 3, 4]
    assert {r["o"] for r in R.best_per_key(df, ["n"], [F.col("o")]).collect()} == {1, 2, 3, 4}


def test_either_key(spark):
    df = spark.createDataFrame([("1", "a"), (None, "b"), ("3", "c")], "fo_id string, name string")
    ok = spark.createDataFrame([("1", "z"), (None, "b"), (None, "c")], "fo_id string, name string")
    assert {r["name"] for r in R.either_key_semi(df, ok, "fo_id", "name").collect()} == {"a", "b"}


def test_hits_first_and_ranks(spark):
    all_ = spark.createDataFrame([(i, float(i % 3)) for i in range(6)], "k long, v double")
    assert [r["k"] for r in R.hits_first(all_.where("k in (4, 2)"), all_, "k", "k").collect()] == [2, 4, 0, 1, 3, 5]
    assert [r["k"] for r in R.ranked(all_, "v", "k", F.col("v") > 0).orderBy("rank").collect()] == [2, 5, 1, 4]
    assert R.append_batch(all_, all_.select("k")).count() == 12
    shapes = spark.createDataFrame([("United States of America",), ("France",)], "shape string")
    got = R.contains_either_way(spark.createDataFrame([("United States",), ("Peru",)], "c string"), shapes, "c", "shape").collect()
    assert {r["c"]: r["shape"] for r in got} == {"United States": "United States of America", "Peru": None}


def test_numbered_alike_at_every_size(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, rnd.randrange(20)) for i in range(500)], "k long, v int").repartition(7)
    small, large = (sorted(map(tuple, R.numbered(df, [F.desc("v"), "k"], "n", most).collect())) for most in (1000, 10))
    assert small == large


def test_names_within_names(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abA") for _ in range(rnd.randint(0, 7)))
    rows, names = [(i, word()) for i in range(60)] + [(60, None)], sorted({word() for _ in range(40)} - {""}) + [""]
    got = R.contains_either_way(spark.createDataFrame(rows, "i long, c string"), spark.createDataFrame([(n,) for n in names], "shape string"), "c", "shape").collect()
    near = lambda a, b: a and b and (a.lower() in b.lower() or b.lower() in a.lower())
    want = [(i, n) for i, c in rows for n in ([n for n in names if near(c, n)] or [None])]
    assert sorted(((r["i"], r["shape"]) for r in got), key=repr) == sorted(want, key=repr)
