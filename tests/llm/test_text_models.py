"""Operators 2, 4 and 7."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import chat, quality, toxicity


def brute_kn(texts, order):
    """Interpolated modified Kneser-Ney by the book: a function of context and symbol."""
    grams = collections.Counter()
    for t in texts:
        s = (0,) * (order - 1) + tuple(t)
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount, totals, kinds = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        discount[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.05) if n[i - 1] else 0.5 for i in (1, 2, 3)]
        totals[k], kinds[k] = collections.Counter(), collections.defaultdict(collections.Counter)
        for g, v in c.items():
            totals[k][g[:-1]] += v
            kinds[k][g[:-1]][min(v, 3)] += 1

    def p(g):
        if not g:
            return 1 / quality.CODE_POINTS
        k = len(g)
        if not totals[k][g[:-1]]:
            return p(g[1:])
        left = sum(discount[k][i] * n for i, n in kinds[k][g[:-1]].items())
        return (max(counts[k][g] - discount[k][min(counts[k][g], 3)], 0) + left * p(g[1:])) / totals[k][g[:-1]]

    return p


def test_kneser_ney(spark):
    rnd = random.Random(5)
    taught = ["".join(rnd.choice("abcdé 語") for _ in range(rnd.randint(0, 80))) for _ in range(30)]
    other = ["xyz abc", "", "dé dé dé", "日本語 abc", "A\tb\n", "🙂" * 9, None]
    rows = [(t, True) for t in taught] + [(t, False) for t in other]
    df = spark.createDataFrame(rows, "text string, taught boolean").withColumn("code", F.lit(3).cast("long")).cache()
    model = quality.hashed_model(quality.kneser_ney(quality.settle(quality.corpus_grams(df)))).cache()
    p = brute_kn([[symbol(c) for c in t] for t in taught], quality.ORDER)
    for how in ({}, {"block": 200, "shard_rows": 100, "blocks_per_task": 3}):
        got = {r["text"]: r for r in quality.score(df.select("text", "code"), model, **how).collect()}
        assert len(got) == len(set(t for t, _ in rows))
        for t, _ in rows:
            s = (0,) * (quality.ORDER - 1) + tuple(symbol(c) for c in t or "")
            want = -sum(math.log(p(s[i : i + quality.ORDER])) for i in range(len(t or "")))
            assert got[t]["symbols"] == len(t or "") and got[t]["surprise"] == pytest.approx(want, rel=1e-4, abs=1e-4)
    with pytest.raises(Exception, match="lacks n-grams"):
        quality.score(spark.createDataFrame([("never seen", 3)], "text string, code long"), model).collect()


def symbol(c):
    return max(32, ord(c))


def test_kneser_ney_sums_to_one():
    taught = [[symbol(c) for c in t] for t in ("abc abd", "日本", "ab")]
    p = brute_kn(taught, 3)
    own = {c for t in taught for c in t}
    for before in ((0, 0), (97, 98), (98, 97)):
        assert sum(p((*before, c)) for c in own) + (quality.CODE_POINTS - len(own)) * p((*before, 7)) == pytest.approx(1, abs=1e-6)


def test_lookup():
    rnd = np.random.default_rng(1)
    key = np.unique(rnd.integers(0, 2**60, 5000))
    value = rnd.random(len(key)).astype(np.float32)
    table = quality.Lookup(key, value)
    assert (table.get(key) == value).all() and (table.get(key + (1 << 61)) == 0).all() and (quality.Lookup(key[:0], value[:0]).get(key) == 0).all()


def test_judge(spark):
    rnd = random.Random(6)
    good = lambda n: " ".join(rnd.choice(["the", "river", "runs", "to", "sea", "and", "hills", "sleep"]) for _ in range(n))
    rows = [(i, good(rnd.randint(20, 60)), "en") for i in range(120)] + [(200 + i, "".join(chr(rnd.randint(33, 120)) for _ in range(200)), "en") for i in range(10)]
    rows += [(300, None, "en"), (301, "", None), (302, good(30), None), (303, good(5000), "en"), (None, good(30), "en"), (0, rows[0][1], "en"), (304, "ok", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep", F.lit("mine")).withColumn("code", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 0), (None, 1), (5, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(not r["keep"] for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 210)
    assert all(r["keep"] for r in got if r["doc_id"] is None or r["doc_id"] < 200 or r["doc_id"] >= 300)
    carried = quality.judge(docs, labels, carry=True)
    assert set(docs.columns) - {"keep", "code"} <= set(carried.columns) and carried.count() == len(rows)
    assert quality.judge(docs, labels.limit(0)).where("NOT keep").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    rnd = random.Random(7)
    bad = ["vileword", "nastyterm", "foulname"]
    text = lambda k: " ".join([f"w{rnd.randrange(300)}" for _ in range(40)] + rnd.choices(bad, k=k))
    rows, labels = [(None, "w1 vileword"), (0, None), (1, ""), (2, "w1 " * 30000 + "vileword foulname")], []
    for i in range(10, 410):
        k = rnd.randint(1, 6) if i % 4 == 0 else 0
        rows.append((i, text(k)))
        labels.append((i, int(k > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("mine")).withColumn("severity", F.lit(1))
    known = spark.createDataFrame([*labels[:300], (None, 1), (10, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs.drop("toxic"), known)
    assert (np.diff(model.thresholds) >= 0).all() and model.grades(np.array([0.0, 5.0])).sum(1) == pytest.approx([1, 1])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = labels[300:]
    assert np.mean([got[i]["toxic"] == bool(t) for i, t in held]) >= 0.95
    assert got[2]["toxic"] and got[None]["toxic"] and not got[0]["toxic"] and not got[1]["toxic"]
    many, one = (toxicity.score_toxicity(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()["expected_severity"] for t in (" ".join(bad * 4), bad[0]))
    assert 0 < one < many <= 3
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    twice = docs.drop("toxic").union(docs.drop("toxic").where("doc_id % 3 = 0").withColumn("text", F.lit("w1 w2")))
    again = [toxicity.train(twice.repartition(n), known) for n in (1, 5)]
    assert (again[0].places == again[1].places).all() and again[0].weights == pytest.approx(again[1].weights)
    none = toxicity.train(docs.drop("toxic"), known.where("toxic = 0"))
    assert toxicity.score_toxicity(docs, none).where("toxic").count() == 0


HARD = [r"\### Assistant: </turn> ok", "<turn user>", "<next>", "a\\b\\l\\g", "", "\n</turn>\n", "é<>🙂"]


def test_chat_round_trip(spark):
    rnd = random.Random(8)
    rows = [(1, 0, None, None), (1, 1, None, "x"), (None, 0, "user", "q"), (2, None, "assistant", "early"), (2, 1, "assistant", "late"), (2, 1, "assistant", "late")]
    for c in range(3, 40):
        rows += [(c, t, rnd.choice(["user", "assistant", "system", "od<d>\n"]), rnd.choice(HARD) + rnd.choice(HARD)) for t in range(rnd.randint(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss")))
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == [x[2:] for x in turns]
        assert got[c]["learnt"] == "".join(x[3] for x in turns if x[2] == "assistant")
        merged = sum(i == 0 or turns[i - 1][2] != x[2] for i, x in enumerate(turns))
        assert got[c]["formatted"].count("</turn>\n") == merged
        for s, x in zip(got[c]["loss"], [x for x in turns if x[2] == "assistant"], strict=True):
            assert got[c]["formatted"][s["start"] : s["start"] + s["length"]].replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") == x[3]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """Many turns: linear work, and runs of one role of any length."""
    rows = [(1, t, "user" if (t // 700) % 2 else "assistant", f"t{t}") for t in range(6000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select(F.size(chat.read_back(F.col("formatted"))).alias("n"), F.size("loss").alias("l"), (F.size(F.split("formatted", "</turn>\n")) - 1).alias("m")).first()
    assert (got["n"], got["l"], got["m"]) == (6000, sum(r[2] == "assistant" for r in rows), 9)
    few = spark.createDataFrame([(c, t, "user" if t % 5 == 0 else "assistant", f"<{t}>") for c, n in enumerate((1, 2, chat.BLOCK, chat.BLOCK + 1, 3 * chat.BLOCK)) for t in range(n)], "conv_id long, turn long, role string, text string")
    said = chat.format_conversations(few).select("conv_id", "loss", chat.loss_text(F.col("formatted"), F.col("loss")).alias("t"))
    want = few.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "").alias("t"))
    assert {r["conv_id"]: r["t"] for r in said.collect()} == {0: ""} | {r["conv_id"]: r["t"] for r in want.collect()}


def test_chat_digest(spark, sf_dir):
    rows = {r["conv_id"]: r for r in chat.op7_chat_formatting(spark, sf_dir).collect()}
    text = r"\### Assistant: </turn> ok"
    assert rows[-7]["n_turns"] == 2 and rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-7]["loss_chars"] == len(text) and rows[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_languages_and_scripts_stay_apart(spark):
    """Models that pool languages, or symbols, would keep what these reject: each language's text under the other's name, and other characters of the same script."""
    rnd = random.Random(21)
    text = lambda letters, n: " ".join("".join(rnd.choice(letters) + rnd.choice("aeiou") for _ in range(2)) for _ in range(n))
    han = lambda low: "".join(chr(low + rnd.randrange(40)) for _ in range(150))
    rows, labels = [], []
    for lang, make in (("de", lambda: text("bdg", 60)), ("pl", lambda: text("szk", 60)), ("zh", lambda: han(0x4E00))):
        for _ in range(150):
            labels.append((len(rows), 1))
            rows.append((len(rows), make(), lang))
    strange = [(1000, text("szk", 60), "de"), (1001, text("bdg", 60), "pl"), (1002, han(0x5E00), "zh"), (1003, han(0x6E00), "zh")]
    got = {r["doc_id"]: r["keep"] for r in quality.judge(spark.createDataFrame(rows + strange, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(got[i] for i, *_ in strange) and sum(got[i] for i in range(450)) >= 440


def test_op2_repeats_and_rejects_junk(spark, sf_dir):
    """The registered query: same rows twice, held to the labels."""
    got, again = ({r["doc_id"]: (r["perplexity"], r["keep"]) for r in quality.op2_quality_classifier(spark, sf_dir).collect()} for _ in range(2))
    assert set(got) == set(again) and all(got[i][0] == pytest.approx(again[i][0]) and got[i][1] == again[i][1] for i in got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    bad, good = [i for i, q in labels.items() if q == 0], [i for i, q in labels.items() if q == 1]
    assert np.mean([got[i][1] for i in bad]) <= 0.1 and np.mean([got[i][1] for i in good]) >= 0.95


def test_blocks_are_smaller_when_texts_return(spark, monkeypatch):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), "id").alias("text"), F.lit("en").alias("lang"))
    labels, seen, blocked = rows.select("doc_id", F.lit(1).alias("quality")), [], quality.blocked
    monkeypatch.setattr(quality, "BLOCK", 2000)
    monkeypatch.setattr(quality, "blocked", lambda docs, blocks: (seen.append(blocks), blocked(docs, blocks))[1])
    plain, carried = (quality.judge(rows, labels, carry=c).select("doc_id", "symbols", F.round("perplexity", 4), "keep").collect() for c in (False, True))
    assert sorted(plain) == sorted(carried) and len(plain) == 600
    assert seen[1] >= 2 * seen[0] - 1 > 10


def test_judge_sees_the_order_of_words(spark):
    rnd = random.Random(12)
    line = "the quiet river runs down to the wide sea and the old hills sleep under a pale cold moon while nobody counts these slow grey hours".split()
    good = lambda: " ".join(line[rnd.randrange(8) :] + line + line[: rnd.randrange(1, 20)])
    mixed = lambda: " ".join(rnd.sample(line * 2, 2 * len(line)))
    rows = [(i, good(), "en") for i in range(150)] + [(200 + i, mixed(), "en") for i in range(10)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")).collect()
    assert not any(r["keep"] for r in got if r["doc_id"] >= 200)


def test_thresholds_have_no_slack(spark):
    rnd = random.Random(14)
    text = lambda: " ".join(rnd.choice(["the", "river", "runs", "to", "sea"]) for _ in range(rnd.randint(20, 60)))
    rows = [(i, text(), "en") for i in range(120)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")).collect()
    assert got[0]["threshold"] <= max(r["perplexity"] for r in got)
    good, bad = [(p / 100, False) for p in range(200, 300)], [(p / 100, True) for p in range(310, 330)]
    rows = [("a", *x) for x in good + bad] + [("b", *x) for x in good] + [("c", *x) for x in bad]
    cuts = {r["lang"]: r["threshold"] for r in quality.cuts_of(spark.createDataFrame(rows, "lang string, perplexity double, poor boolean")).collect()}
    assert set(cuts) == {"a", "b"} and 2.99 < cuts["a"] < 3.1 and cuts["b"] == pytest.approx(2.98, abs=0.011)


def test_each_language_has_its_own_discounts(spark):
    """A small language beside one of fifty times its size: each as if it were alone."""
    rnd = random.Random(6)
    taught = {1: ["".join(rnd.choice("abcde ") for _ in range(60)) for _ in range(50)], 2: ["abab acab", "aabb ab", "acca"]}
    df = spark.createDataFrame([(t, c, True) for c, ts in taught.items() for t in ts], "text string, code long, taught boolean")
    model = quality.hashed_model(quality.kneser_ney(quality.settle(quality.corpus_grams(df))))
    got = {(r["code"], r["text"]): r["surprise"] for r in quality.score(df.select("text", "code"), model).collect()}
    for c, ts in taught.items():
        p = brute_kn([[symbol(x) for x in t] for t in ts], quality.ORDER)
        for t in ts:
            s = (0,) * (quality.ORDER - 1) + tuple(symbol(x) for x in t)
            assert got[c, t] == pytest.approx(-sum(math.log(p(s[i : i + quality.ORDER])) for i in range(len(t))), rel=1e-4)


def invalid(spark):
    """Texts of a Parquet file that are not UTF-8, beside others."""
    rows = [(1, b"\x80ab good text", "en"), (2, "ends within é".encode()[:-1], "en"), (3, b"\x80\x80 begins within", "en"), (4, "good text".encode(), "en"), (5, b"\xff\xfe", "en"), (6, None, "en"), (7, b"", "en")]
    return spark.createDataFrame([(d, None if t is None else bytearray(t), x) for d, t, x in rows], "doc_id long, text binary, lang string").withColumn("text", F.col("text").cast("string"))


def test_bytes_that_are_not_text(spark):
    labels = spark.createDataFrame([(4, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["symbols"] for r in quality.judge(invalid(spark).coalesce(1), labels).collect()}
    assert got == {1: 13, 2: 13, 3: 16, 4: 9, 5: 2, 6: 0, 7: 0}
    assert {r["doc_id"]: r["symbols"] for r in quality.judge(invalid(spark).repartition(5), labels).collect()} == got
