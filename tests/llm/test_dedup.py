"""Operators 1, 3 and 6 against brute force, with nulls, empty and long texts, ties, copies, empty tables and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import _dist, _text, embeddup, neardup, repeats, suffix

DOCS = "doc_id long, text string"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    rows, i = [(0, None), (1, ""), (2, "one two"), (3, "One, two!"), (4, "%%% !!!"), (5, "%%% !!!"), (6, None), (None, "null id text of some more words here"), (7, " ")], 8
    base = [words(rnd, 120) for _ in range(6)]
    for b in base:
        for k in range(n // 6):
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((i, " ".join(w) + ("." * k)))
            i += 1
    rows.append((i, " ".join(words(rnd, 6000, 10**6))))
    rows += [rows[12], rows[12]]
    return rows


def shingle_set(text, width=5):
    w = "".join(c if (c.isascii() and c.isalnum()) or not c.isascii() else " " for c in text.lower()).split()
    return tuple(w), {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_classes(rows, least=0.8):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            (a, s), (b, t) = sets[i], sets[j]
            same = a == b and a or (not a and not b and rows[i][1] == rows[j][1] and (rows[i][1] or "") != "")
            if same or (s and t and len(s & t) >= least * len(s | t)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, min(ids[root(i)]) if ids[root(i)] else None) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("bucket", "group"), [(256, 1000), (4, 3)])
def test_near_duplicates(spark, bucket, group):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), bucket=bucket, group=group)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got.collect()), key=repr) == brute_classes(rows)


def test_deduplicate_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7), (2, "A b c d e f!", 8), (1, "a b c d e f", 7), (3, None, 9), (4, None, 9)], DOCS + ", class_id int").withColumn("node", F.lit("x"))
    got = neardup.deduplicate(rows)
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    assert neardup.deduplicate(rows.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(1)
    e = rnd.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.arange(0, 300), np.arange(60, 360)
    w = rnd.integers(1, 4, 400).astype(float)
    for weight in (None, w, w + 0.5):
        k = 2000
        sig = neardup.darts(np.concatenate([e[a], e[b]]), np.repeat([0, 1], 300), None if weight is None else np.concatenate([weight[a], weight[b]]), 2, k)
        x = np.ones(400) if weight is None else weight
        true = x[60:300].sum() / x[:360].sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    assert (neardup.darts(e[:1], np.zeros(1, int), None, 2, 64)[1] == np.uint64(2**64 - 1)).all()


def test_words_and_shingles():
    texts = ["Ab cd, ef", "", "ab CD ef", "é ñ", "a b c d e f"]
    raw = [t.lower().encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, owner, counts = _text.words(data, off)
    assert counts.tolist() == [3, 0, 3, 2, 6] and (h[:3] == h[3:6]).all() and len(set(h[6:].tolist())) == 8
    s, own = _text.shingles(h, owner, counts, 5)
    assert own.tolist() == [0, 2, 3, 4, 4] and s[0] == s[1] and len(set(s.tolist())) == 4


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in _dist.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(got.get(x, x) == root(x) for x in parent)


def test_suffix_arrays():
    rnd = random.Random(3)
    for _ in range(300):
        n, k = rnd.randint(1, 60), rnd.choice([1, 2, 5, 250])
        s = np.array([rnd.randint(0, k) for _ in range(n)])
        s = np.tile(s, 3)[: 3 * n] if rnd.random() < 0.3 else s
        sa = suffix.suffix_array(s, k + 1)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        pl = suffix.common_prefixes(s, sa, 9)
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            m = 0
            while m < 9 and max(a, b) + m < len(s) and s[a + m] == s[b + m]:
                m += 1
            assert pl[a] == m


def brute_repeats(texts, length):
    seen = collections.Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[False], cover]).astype(int)) == 1)
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[:-1]]) if b else b""
        out.append((len(b), int(cover.sum()), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "most"), [(20, 8, 2000), (20, 8, 1), (24, 8, 2), (200, 64, 2000)])
def test_repeats(spark, length, gram, most):
    rnd = random.Random(length + most)
    passages = [" ".join(words(rnd, rnd.randint(2, 60))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "short"), (None, passages[0] * 3), (3, "aaaa " * 60), (4, passages[0]), (4, passages[0])]
    for i in range(5, 60):
        parts = [" ".join(words(rnd, rnd.randint(0, 25), 10**6)) for _ in range(3)]
        rows.append((i, parts[0] + rnd.choice(passages)[: rnd.randint(5, 400)] + parts[1] + rnd.choice(["", rnd.choice(passages)]) + parts[2]))
    rows += [(60, " ".join(words(rnd, 8000, 10**6)) + passages[1]), (61, rows[10][1]), (62, rows[10][1][:-1] + "é")]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("g", F.lit("x"))
    out = repeats.remove_repeats(df, length, gram, 1 << 12, most)
    got = out.select("doc_id", "g", "n_bytes", F.octet_length("kept").alias("k"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], length)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_bytes"] - r["k"], r["s"], r["h"]) for r in got) == sorted((repr(d), *w) for (d, _), w in zip(rows, want, strict=True))
    assert {r["g"] for r in got} == {"x"} and repeats.remove_repeats(df.limit(0), length, gram).count() == 0


def brute_links(rows, least=0.9):
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max(len(rows[i][1]) for i in ok)
    x = np.array([list(rows[i][1]) + [0.0] * (width - len(rows[i][1])) for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    out = {}
    for a, i in enumerate(ok):
        seen, todo = {a}, [a]
        while todo:
            for b in np.flatnonzero(near[todo.pop()]):
                if b not in seen:
                    seen.add(int(b))
                    todo.append(int(b))
        out[i] = (int(near[a].sum()) - 1, min(rows[ok[b]][0] for b in seen))
    return [out.get(i, (0, d)) for i, (d, _) in enumerate(rows)]


def test_near_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(0, None), (1, [0.0] * 8), (2, [1.0, None] + [0.0] * 6), (3, [float("nan")] + [1.0] * 7), (4, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (5, []), (6, [1.0] * 8), (7, [2.0] * 8), (8, [1.0] * 8)]
    i = 9
    for size in (1, 2, 3, 80, 200):
        centre = rnd.standard_normal(16)
        for _ in range(size):
            rows.append((i, (centre + 0.25 * rnd.standard_normal(16)).tolist()))
            i += 1
    rows += [(i + k, rnd.standard_normal(16).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x"))
    monkeypatch.setattr(embeddup, "BLOCK", 64)
    got = embeddup.near_vectors(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, *w) for (d, _), w in zip(rows, brute_links(rows), strict=True))
    found = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    right = sum((want & found).values())
    assert right >= 0.97 * len(rows)  # recall of the search; the rest is exact
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(w[0] for w in brute_links(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddup.near_vectors(df.limit(0)).count() == 0


def test_links_that_leave_full_lists(spark):
    rnd = np.random.default_rng(8)
    u, v = np.linalg.qr(rnd.standard_normal((48, 2)))[0].T
    far = rnd.standard_normal((20, 48))
    centres = [u, 0.935 * u + np.sqrt(1 - 0.935**2) * v]
    rows = [(100 * g + k, (c + 0.1 * rnd.standard_normal(48) / np.sqrt(48)).tolist()) for g, c in enumerate(centres) for k in range(100)]
    rows += [(200 + k, x.tolist()) for k, x in enumerate(far)]
    want = brute_links(rows)
    assert min(w[0] for w in want[:200]) > 150  # most links lead to the other group
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}


def test_short_search_is_made_up_for(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    rows = [(5 * c + k, (centre + 0.2 * rnd.standard_normal(16)).tolist()) for c, centre in enumerate(rnd.standard_normal((12, 16))) for k in range(5)]
    monkeypatch.setattr(embeddup, "first_lists", lambda nodes, *_: nodes.limit(0).selectExpr("node", "node AS other", "CAST(0 AS FLOAT) AS sim"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute_links(rows), strict=True)} and any(n for n, _ in got.values())


def test_near_duplicates_without_ids(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join([*base, f"end{k}"])) for k in range(3)] + [(None, "another text of some more words here"), (7, " ".join(f"v{i}" for i in range(50)))]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r["text"][:7] for r in neardup.deduplicate(df).collect()) == sorted(["w0 w1 w", "another", "v0 v1 v"])
    assert neardup.near_duplicates(df).where("kept").count() == 3


def test_trees_follow_the_depth():
    angle = np.arccos(0.9) / np.pi
    for n in (10, 10**4, 10**6, 10**8, 10**10):
        depth = embeddup.depth_of(n)
        missed = (1 - (1 - angle) ** depth) ** embeddup.trees_for(depth, 0.9)
        assert missed <= 1 - embeddup.MEET + 1e-9
    assert embeddup.trees_for(0) == 1


def test_lone_pairs_in_deep_trees(spark, monkeypatch):
    """Pairs at 0.90 to 0.92 with no other neighbour, leaves so small that trees are deep: recall of the final links."""
    rnd = np.random.default_rng(17)
    rows = []
    for k in range(300):
        u, v = np.linalg.qr(rnd.standard_normal((32, 2)))[0].T
        c = rnd.uniform(0.9005, 0.92)
        rows += [(2 * k, u.tolist()), (2 * k + 1, (c * u + np.sqrt(1 - c * c) * v).tolist())]
    monkeypatch.setattr(embeddup, "LEAF", 4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {d: w for (d, _), w in zip(rows, brute_links(rows), strict=True)}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want) and sum(n for n, _ in want.values()) == 600


def test_op1_and_op6_against_brute_force(spark, sf_dir):
    """The registered queries over the small tables."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in neardup.op1_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (c, d == c) for d, c in brute_classes(docs)}
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddup.op6_embedding_near_dedup(spark, sf_dir).collect()}
    assert found == {d: w for (d, _), w in zip(vectors, brute_links(vectors), strict=True)}


def test_op3_against_brute_force(spark, sf_dir):
    """The registered query over the small table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op3_suffix_array_dedup(spark, sf_dir).collect()}
    want = brute_repeats([(r["text"] or "").encode() for r in rows], 200)
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}


def test_anchors_of_long_texts(monkeypatch):
    """Stretch by stretch or at once, every string has the same anchor, in periodic texts too."""
    rnd = np.random.default_rng(2)
    data = np.concatenate([np.tile(np.frombuffer(b"abcab", np.uint8), 60), rnd.integers(97, 100, 500).astype(np.uint8), np.zeros(200, np.uint8)])
    of = lambda found: {s: (int(a), int(g)) for _, b, e, a, g, _ in zip(*found, strict=True) for s in range(b, e + 1)}
    off = np.array([0, len(data)])
    want = of(repeats.anchors(data, off, 20, 8))
    for long in (33, 100, 256):
        monkeypatch.setattr(repeats, "LONG", long)
        assert of(repeats.anchors(data, off, 20, 8)) == want and len(want) == len(data) - 19


def test_near_duplicates_of_very_long_texts(spark):
    """Copies of a long text with changed words, compared by joins as their shingles have many bytes."""
    rnd = random.Random(31)
    long = words(rnd, 60_000, 10**6)
    rows = []
    for k in range(6):
        own = list(long)
        for _ in range(600 * k):
            own[rnd.randrange(len(own))] = f"x{rnd.random()}"
        rows.append((k, " ".join(own)))
    rows += [(10, " ".join(words(rnd, 60_000, 10**6))), (11, " ".join(long[:40_000]))]
    df = spark.createDataFrame(rows, DOCS)
    want = brute_classes(rows)
    for limit in (1 << 30, 1 << 16):
        got = neardup.near_duplicates(df, group_bytes=limit).collect()
        assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == want
