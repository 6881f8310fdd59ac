"""Operators 5, 8, 9, 10, the pipeline and the SQL of this subpackage."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import mixing, packing, queries, sharding, topk
from ledgerlake.llm._tokens import WordTokenizer

from ..test_entry import TABLES, compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, duck, name):
    compare(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.SQL[name]))


def docs(spark, n=300):
    rnd = random.Random(9)
    rows = [(i, "x" * rnd.randint(0, 300) + "é", f"s{i % 3}") for i in range(n)] + [(None, "null id", "s0"), (n, None, None), (n + 1, "y" * 200_000, "s1"), (5, "again", "s1"), (5, "again", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("mine")).withColumn("size", F.lit(1))


def test_sharding(spark, tmp_path):
    d = docs(spark)
    out = sharding.external_shuffle(d, 7, 2000)
    rows = out.collect()
    assert len(rows) == d.count() and "source" in out.columns
    for s in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 7) for r in rows) and any(r["grown_shard"] == 7 for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    of = collections.defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values()) and len({r["bucket"] for r in rows}) > 1
    pairs = [(r["doc_id"], r["slot"]) for r in rows if r["shard"] == 0 and r["doc_id"] is not None]
    assert abs(np.corrcoef(np.array(pairs, float).T)[0, 1]) < 0.5
    assert sorted(map(repr, rows)) == sorted(map(repr, sharding.external_shuffle(d.repartition(9), 7, 2000).collect()))
    assert sharding.external_shuffle(d.limit(0), 7).count() == 0
    sharding.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50)) and (sharding.fisher_yates(50, 1) != sharding.fisher_yates(50, 2)).any()


def test_op5_against_brute_force(spark, sf_dir):
    """The registered query: shards recomputed row by row, slots gapless, one more shard takes rows only into itself."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = sharding.op5_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    pairs = spark.createDataFrame([(d, s) for d in docs for s in range(41)], "d long, s int").select("d", "s", F.xxhash64(F.lit(11), "d", "s").alias("h")).collect()
    best = lambda n: {d: s for d, (_, s) in sorted({d: max((r["h"], r["s"]) for r in rows if r["s"] < n) for d, rows in by.items()}.items())}
    by = collections.defaultdict(list)
    for r in pairs:
        by[r["d"]].append(r)
    now, grown = best(40), best(41)
    slots = collections.defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["shard"], r["grown_shard"], r["law"]) == (now[r["doc_id"]], grown[r["doc_id"]], "key") and r["grown_shard"] in (r["shard"], 40)
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("cell", [10**6, 40, 7])
def test_top_k(spark, cell):
    rnd = random.Random(10)
    rows = [(i, [rnd.randint(-5, 5) for _ in range(6)]) for i in range(80)] + [(90, [0] * 6), (91, []), (92, [1, 2]), (93, [3] * 6), (94, [3] * 6), (0, [9] * 6), (None, [9] * 6), (95, [2**55 + 1] + [0] * 5)]
    v = spark.createDataFrame(rows, "vec_id long, x array<long>").withColumn("score", F.lit("mine"))
    got = topk.exact_top_k(v, v.where("vec_id % 10 = 0"), 5, cell, max(cell // 2, 2)).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = []
    for q in {q for q, _ in rows if q is not None and q % 10 == 0}:  # rows of one id are one query, the best of them count
        found = sorted((-dot(x, y), i) for d, x in rows if d == q for i, y in rows if i is not None and i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.exact_top_k(v.limit(0), v, 5).count() == 0 and topk.exact_top_k(v, v.limit(0), 5).count() == 0


def test_op8_leaves_out_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, [1.0, nan]), (2, [inf, 0.0]), (3, None), (4, [None, 1.0]), (5, [-0.01, 2.0]), (20, [1.0, 1.0]), (None, [9.0, 9.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(7)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op8_exact_top_k(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 1, 20, 32 * 64 + 16 * 64), (0, 2, 5, -32 + 16 * 128), (20, 1, 5, -64 + 64 * 128), (20, 2, 0, 32 * 64 + 16 * 64)]


def test_threshold_algorithm_stops_early():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-64, 64, (5000, 8)).astype(float)
    lists = topk.SortedLists(np.arange(5000), x)
    q = np.array([9.0, 0, 0, 0, 0, 0, 0, -1])
    places, scores = lists.top(-1, q, 20)
    order = np.lexsort((np.arange(5000), -(x @ q)))[:20]
    assert places.tolist() == order.tolist() and (scores == (x @ q)[order]).all()


@pytest.mark.parametrize("capacity", [10, 37, 100])
def test_packing_solver(capacity):
    rnd = np.random.default_rng(capacity)
    for _ in range(20):
        lengths = rnd.integers(1, capacity + 1, rnd.integers(1, 200))
        s = packing.Solver(np.bincount(lengths, minlength=capacity + 1), capacity)
        runs = s.solve()
        used = collections.defaultdict(list)
        for r in runs.itertuples():
            for i in range(r.n):
                used[r.sequence + i // r.per].append((r.offset + i % r.per * r.length, r.length))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == s.sequences
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        rest, plain = sorted(lengths, reverse=True), []
        for x in rest:
            fit = [i for i, room in enumerate(plain) if room >= x]
            if fit:
                plain[min(fit, key=lambda i: plain[i])] -= x
            else:
                plain.append(capacity - x)
        assert -(-lengths.sum() // capacity) <= s.sequences <= len(plain) + 1


def brute_bins(lengths, capacity):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                j = rooms.index(r)
                place(i + 1, rooms[:j] + [r - lengths[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rnd = random.Random(4)
    for _ in range(60):
        lengths = sorted((rnd.randint(3, 20) for _ in range(9)), reverse=True)
        s = packing.Solver(np.bincount(lengths, minlength=21), 20)
        s.reduce()
        left = [x for x in range(20, 0, -1) for _ in range(int(s.counts[x]))]
        assert s.fixed + (brute_bins(left, 20) if left else 0) == brute_bins(lengths, 20)


ODD = ["héllo² ½ ÀÉ ẞ ΑΣ x", "<|endoftext|> hi", "a\x1cb\x85c\xa0d", "don't we'll THEY'VE  'd", "İstanbul ŉ ǆ Ǆ 'S", "é é", "12 3٣ ①", "", "\n\n", "ªº µ × ÷ _-_ a_b ʼn", "x" * 30_000, "!'s ''' '"]


def test_tokens_and_packing(spark):
    t = WordTokenizer(packing.word_bpe_path())
    for got, text in zip(t.encode(ODD), ODD, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids
    rnd = random.Random(5)
    rows = [(i, x) for i, x in enumerate(ODD)] + [(None, None), (3, ODD[3])] + [(100 + i, " ".join(rnd.choice(["alpha", "beta", "qqz"]) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("piece", F.lit(1))
    for group in (10**6, 5):
        got = packing.pack(d, 32, rows_per_group=group).collect()
        spans = collections.defaultdict(list)
        for r in got:
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in spans.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 32
        want = collections.Counter()
        for i, x in rows:
            ids = t.whole.encode(x or "", add_special_tokens=False).ids + [1]
            for p, a in enumerate(range(0, len(ids), 32)):
                part = np.array(ids[a : a + 32], "<u4").tobytes()
                want[(i, p, a, len(part) // 4, zlib.crc32(part))] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        assert len(spans) <= 1.05 * sum(r["length"] for r in got) / 32 + 1
    assert packing.pack(d.limit(0)).count() == 0


def test_mixing(spark):
    d = docs(spark).withColumn("copies", F.lit("mine"))
    plan = mixing.plan(d).collect()
    assert len(plan) == d.count() and all(r["copies"] <= 2 for r in plan)
    total, sources = sum(r["size"] for r in plan), {r["source"]: r for r in plan}
    assert sum(r["target"] for r in sources.values()) == pytest.approx(1.5 * total)
    mix = mixing.mixture(d)
    assert mix.columns == d.columns and mix.count() == sum(r["copies"] for r in plan)
    assert sorted(map(repr, mixing.plan(d.repartition(5)).select("doc_id", "copies").collect())) == sorted(repr(r) for r in mixing.plan(d).select("doc_id", "copies").collect())
    assert mixing.mixture(d.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "a b c", "s") for i in range(4000)] + [(i, "a", "t") for i in range(4000, 5000)], "doc_id long, text string, source string")
    taken = {r["source"]: r for r in mixing.plan(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect()}
    assert all(abs(r["n"] / r["t"] - 1) < 0.06 for r in taken.values())


def test_pipeline(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = d.columns, d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == columns, name
        rows = spark.createDataFrame(rows.collect(), d.schema)
        assert 0 < rows.count() <= 2 * d.count()
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert out.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), sf_dir).count() == 0


def test_stages_take_odd_documents(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns that operators would add."""
    rnd = random.Random(3)
    line = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    rows = [(i, line(60), "en", f"s{i % 2}", 300) for i in range(40)]
    rows += [(None, None, None, None, None), (50, None, "en", "s0", 0), (51, "", "en", None, 0), (52, "!!", None, "s0", 2), (53, line(30_000), "fr", "s1", 1), rows[0], rows[0], (0, line(20), "en", "s1", 5), (None, line(9), "xx", "s0", 1)]
    clash = ["keep", "code", "taught", "surprise", "kept", "removed", "raw", "size", "copies", "extra_1", "_block"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (0, 0), (999, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert docs.count() == len(rows)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == docs.columns and now.select(*clash).distinct().count() == 1, name
        assert now.where("doc_id = 52").count() >= (name != "mixing sources to target weights")
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).where("doc_id IS NOT NULL").count() >= now.where("doc_id IS NOT NULL").count()
    quality = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert quality.where("text IS NULL OR text = '' OR lang = 'xx'").count() == 4


def test_mixing_moves_no_text(spark, sf_dir, monkeypatch):
    """The table of sources is broadcast however large the documents; beyond its bound the common sources' still is, and the mix is the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.repeat("text", 10))
    out = mixing.mixture(docs)
    want = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mixture(docs)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not any("Exchange hashpartitioning" in line and "source" in line for line in plan.splitlines())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for common in (200, 18):
        monkeypatch.setattr(mixing, "SOURCES", 3)
        monkeypatch.setattr(mixing, "COMMON", common)
        assert sorted(r["doc_id"] for r in mixing.mixture(docs).select("doc_id").collect()) == want


def test_packing_takes_bytes_that_are_not_text(spark):
    from .test_text_models import invalid

    out = packing.pack(invalid(spark))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(1, 8))
