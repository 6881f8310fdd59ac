"""Operator 12 against brute force."""

import collections
import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from ledgerlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(ts)] for c, ts in turns.items()}
    members = collections.defaultdict(list)
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        whole[c] = tuple(seq)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        ends = ",".join(str(c) for c in sorted(c for c in who if whole[c] == node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        children = sum(len(m) == len(node) + 1 and m[:-1] == node for m in members)
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told(df):
    return {(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


def made(seed, convs, most, words):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-120, 900), convs)
    return [(c, t, rnd.choice(["user", "assistant", None, ""]), rnd.choice(words)) for c in ids for t in range(rnd.randint(1, most))]


def test_against_brute_force(spark):
    rows = made(1, 60, 7, ["a", "é𝄞", "", None])
    rows += [(c, t, "user", f"same {t}") for c in range(300, 400) for t in range(9)]  # one conversation, a hundred times over
    rows += [(700, t, "user", "long" * (t % 3)) for t in range(37)] + [(703, t, "user", "long" * (t % 3)) for t in range(70)]
    rows += [(5, None, "system", "null turn"), (5, 1, "user", "twice"), (5, 1, "user", "twice"), (5, 1, "assistant", "once"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(1001, 0, "user", "alone"), (2000, 0, "user", "one turn"), *[(c, 0, "user", "short") for c in range(2001, 2030)]]  # absent and short first conversations, turnless ones
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit("mine") for c in ("name", "d", "last", "fp", "at", "_id", "base", "h")})
    out = trie.conversation_trie(df)
    assert told(out) == brute(rows)
    assert out.count() == len(brute(rows)) and out.select("name").distinct().count() == out.count()


def test_names_are_dense(spark):
    """Prefixes of powers of two, one less and one more turns; names run from 0 without gaps."""
    rows = [(100 * c, t, "user", f"{c % 2 if t > 6 else 0}") for c, n in enumerate((1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 33)) for t in range(n)]
    out = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert told(out) == brute(rows)
    assert sorted(r["name"] for r in out.select("name").collect()) == list(range(out.count()))


def test_many_ends(spark, monkeypatch):
    """A node with more ends than a stretch of ids holds, in batches that cut its stretches apart."""
    monkeypatch.setattr(trie, "STRETCH", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, 0, "user", "x") for c in range(-50, 250)]
        assert told(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    long = [(0, 0, "user", "x" * 200_000), (0, 1, None, None), (6, 0, "user", "y")]
    assert told(trie.conversation_trie(spark.createDataFrame(long, SCHEMA))) == brute(long)
