"""Operator 6: near-duplicate vectors by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import components, settle
from ._vectors import matrix, usable, widened

COSINE = 0.9
#: Length of the neighbour lists; lists full of links are doubled up to LONGEST.
NEIGHBOURS, LONGEST = 12, 48
#: The first lists come from random-projection trees with leaves of about LEAF vectors, so many that a pair at the
#: threshold is in one leaf of one of them with probability MEET at least, however deep they are.
LEAF, MEET = 128, 0.98
ROUNDS, AUDITED, RECALL, EXTRA = 2, 1024, 0.97, 2
#: Neighbour search runs on components rounded to 8 bits; links are checked on doubles, so this much below may still be one.
MARGIN = 0.015
#: Vectors of a component that one task compares with one another.
BLOCK = 2048
#: Nodes of a component within so many radians of one another's centre are a cluster; SLOP is what arccos may be wrong by.
TIGHT, SLOP = 0.2, 1e-6


def _bytes8(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.rint(x / np.where(top > 0, top, 1) * 127).astype(np.int8)


def _unit8(rows) -> np.ndarray:
    """Unit vectors from their 8-bit forms."""
    a = matrix([np.frombuffer(r, np.int8) for r in rows], np.float32)
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(norm > 0, norm, 1)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, copies, x, q): one row for each different vector that is usable and not zero; node is its smallest vec_id."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(usable(F.col("x")) & F.exists("x", lambda v: v != 0))
    same = rows.groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = matrix(b["x"])
            b["q"] = [r.tobytes() for r in _bytes8(a)]
            yield b

    return same.select("node", "copies", "x").mapInPandas(pack, "node long, copies long, x array<double>, q binary")


def depth_of(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def trees_for(depth: int, cosine: float = COSINE, meet: float = MEET) -> int:
    """Random planes part two vectors with probability angle / pi; trees of so many planes that they meet in one leaf of one tree."""
    together = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** depth
    return 1 if together >= meet else int(np.ceil(np.log(1 - meet) / np.log(1 - together)))


def leaves(nodes: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """(leaf, node, q): the leaf of every vector in every tree; a leaf is the side of depth random planes."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = _unit8(b["q"])
            for t in range(trees):
                planes = np.random.default_rng([seed, t, a.shape[1]]).standard_normal((a.shape[1], max(depth, 1))).astype(np.float32)
                side = ((a @ planes) > 0) @ (1 << np.arange(max(depth, 1), dtype=np.int64)) if depth else np.zeros(len(a), np.int64)
                yield pd.DataFrame({"leaf": side * 65536 + t, "node": b["node"], "q": b["q"]})

    return nodes.select("node", "q").mapInPandas(walk, "leaf long, node long, q binary")


def _groups(rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """work(rows of one key) over all keys; partitions are sorted and read group by group."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            k = rows[key].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            out = [work(rows.iloc[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            last = b[key].iloc[-1]
            if held[0][key].iloc[0] != last:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted((rows[key] == last).to_numpy(), True))
                held = [rows.iloc[cut:]]
                yield from done(rows.iloc[:cut])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(scan, schema)


def first_lists(nodes: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """Candidate neighbours (node, other, sim): in each leaf the most similar ones of every vector."""
    rows = leaves(nodes, trees, depth_of(n), seed)
    # leaves that hold much more than their share are dealt by hash
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("size"))
    part = F.xxhash64("leaf", F.pmod(F.xxhash64("node", F.lit(seed), "leaf"), F.ceil(F.col("size") / (2 * LEAF))))
    rows = rows.join(sizes, "leaf").select(part.alias("leaf"), "node", "q")

    def near(group: pd.DataFrame) -> pd.DataFrame | None:
        if len(group) < 2:
            return None
        ids, a = group["node"].to_numpy(), _unit8(group["q"])
        sims = a @ a.T
        np.fill_diagonal(sims, -2)
        k = min(NEIGHBOURS // 2, len(ids) - 1)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(ids)), k)
        j = best.reshape(-1)
        return pd.DataFrame({"node": ids[i], "other": ids[j], "sim": sims[i, j]})

    return _groups(rows, "leaf", near, "node long, other long, sim float")


def shortened(found: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """The lists: the best of found for each node, NEIGHBOURS or what sizes(node, k) says, each once."""
    once = found.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    k = F.lit(NEIGHBOURS)
    if sizes is not None:
        once, k = once.join(sizes, "node", "left"), F.coalesce("k", F.lit(NEIGHBOURS))
    order = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    return once.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).select("node", "other", "sim", "old")


def descend(lists: DataFrame, nodes: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """One round: around every node its neighbours, and those it is a neighbour of, meet and offer themselves to one another."""
    low = lists.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select("node", F.when(F.col("n") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.col("low")).cast("float").alias("low"))
    around = lists.select(F.col("node").alias("centre"), F.col("other").alias("node"), "old").union(lists.select(F.col("other").alias("centre"), "node", "old"))
    around = around.groupBy("centre", "node").agg(F.min("old").alias("old"))
    order = Window.partitionBy("centre").orderBy("old", F.xxhash64("node", "centre"))
    around = around.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= 2 * LONGEST).drop("_place")
    rows = around.join(nodes.select("node", "q"), "node").join(low, "node", "left").select("centre", "node", "old", "q", F.coalesce("low", F.lit(-2.0)).alias("low"))

    def meet(group: pd.DataFrame) -> pd.DataFrame | None:
        old = group["old"].to_numpy()
        if len(group) < 2 or old.all():
            return None
        ids, a, least = group["node"].to_numpy(), _unit8(group["q"]), group["low"].to_numpy()
        sims = a @ a.T
        better = (sims > least[:, None]) & ~(old[:, None] & old[None, :])
        np.fill_diagonal(better, False)
        i, j = np.nonzero(better)
        return pd.DataFrame({"node": ids[i], "other": ids[j], "sim": sims[i, j]})

    offers = _groups(rows, "centre", meet, "node long, other long, sim float").groupBy("node", "other").agg(F.max("sim").alias("sim"))
    return settle(shortened(lists.withColumn("old", F.lit(True)).union(offers.withColumn("old", F.lit(False))), sizes))


def _unit(rows) -> np.ndarray:
    """Unit vectors on doubles."""
    a = matrix(rows)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def audit(loose: DataFrame, nodes: DataFrame, cosine: float) -> float:
    """Share of the links of AUDITED nodes, found by comparing them with all, whose two ends are in one component of loose(id, root)."""
    sample = nodes.orderBy(F.xxhash64(F.lit(9), "node")).limit(AUDITED).select("node", "x").toPandas()  # AUDITED rows at most
    ids, held = sample["node"].to_numpy(), nodes.sparkSession.sparkContext.broadcast(_unit(sample["x"]) if len(sample) else np.zeros((0, 0)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            a = _unit(b["x"])
            width = max(a.shape[1], held.value.shape[1])
            i, j = np.nonzero(widened(held.value, width) @ widened(a, width).T >= cosine)
            out = pd.DataFrame({"a": ids[i], "b": b["node"].to_numpy()[j]})
            yield out[out["a"] != out["b"]]

    true = nodes.select("node", "x").mapInPandas(compare, "a long, b long")
    root = lambda end: loose.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    met = true.join(root("a"), "a", "left").join(root("b"), "b", "left")
    row = met.agg(F.count("*").alias("n"), F.sum((F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False))).cast("int")).alias("found")).first()
    return row["found"] / row["n"] if row["n"] else 1.0


def clusters(members: DataFrame) -> DataFrame:
    """(cluster, root, node, x, radius) over members(root, node, x): nodes of one component within TIGHT of the cluster's node, radius their largest angle to it."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    part = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)))
    rows = members.join(sizes, "root").select(part.alias("key"), "root", "node", "x")

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        a, ids = _unit(group["x"]), group["node"].to_numpy()
        cluster, radius = np.zeros(len(a), np.int64), np.zeros(len(a))
        todo = np.arange(len(a))
        while len(todo):
            angle = np.arccos(np.clip(a[todo] @ a[todo[0]], -1, 1))
            angle[0] = 0
            mine = angle <= TIGHT
            cluster[todo[mine]], radius[todo[mine]] = ids[todo[0]], angle[mine].max()
            todo = todo[~mine]
        return pd.DataFrame({"cluster": cluster, "root": group["root"].to_numpy(), "node": ids, "x": list(a), "radius": radius})

    return _groups(rows, "key", lead, "cluster long, root long, node long, x array<double>, radius double")


def cross_links(members: DataFrame, cosine: float) -> DataFrame:
    """(a, b): links between the components of members(root, node, x), one at least for every two components that have any. Nothing is lost.

    Components are covered by tight clusters. Centres are compared in blocks; by the triangle inequality two clusters
    can share a link only if their centres are no further apart than the link's angle and both radii. Where the centres
    are linked that is enough; the members of other such clusters are compared one by one.
    """
    held = settle(clusters(members))
    centres = settle(held.where("cluster = node").select("root", "node", "x", "radius"))
    blocks = max(1, -(-centres.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(blocks)).cast("int")
    # the cells of block b: (least, greatest) of b and every block
    dealt = centres.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select((F.least("b", "o").cast("long") * blocks + F.greatest("b", "o")).alias("cell"), "b", "root", "node", "x", "radius")
    reach = float(np.arccos(np.clip(cosine, -1, 1))) + SLOP

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        cell = int(group["cell"].iloc[0])
        left, right = (np.flatnonzero(group["b"].to_numpy() == v) for v in divmod(cell, blocks))
        a, ids, roots, radius = matrix(group["x"]), group["node"].to_numpy(), group["root"].to_numpy(), group["radius"].to_numpy()
        out = []
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            sims = a[rows] @ a[right].T
            near = np.arccos(np.clip(sims, -1, 1)) <= reach + radius[rows][:, None] + radius[right][None, :]
            i, j = np.nonzero(near & (roots[rows][:, None] != roots[right][None, :]))
            x, y = rows[i], right[j]
            out.append(pd.DataFrame({"a": ids[x], "b": ids[y], "p": np.minimum(roots[x], roots[y]), "q": np.maximum(roots[x], roots[y]), "sure": sims[i, j] >= cosine}))
        out = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "p": [], "q": [], "sure": []})
        linked = out["sure"] & ~out[out["sure"]].duplicated(["p", "q"]).reindex(out.index, fill_value=False)
        known = out[["p", "q"]].merge(out.loc[linked, ["p", "q"]], on=["p", "q"], how="left", indicator=True)["_merge"].eq("both").to_numpy()
        return out[linked.to_numpy() | ~known]

    met = settle(_groups(dealt, "cell", meet, "a long, b long, p long, q long, sure boolean"))
    sure = met.where("sure").select("a", "b")
    roots = components(met.where("sure").select(F.col("p").alias("a"), F.col("q").alias("b")))
    same = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    apart = F.coalesce("p_root", "p") != F.coalesce("q_root", "q")
    open_ = met.where("NOT sure").join(same("p"), "p", "left").join(same("q"), "q", "left").where(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [open_.join(held.select(F.col("cluster").alias(end), "node", "x"), end).select(F.xxhash64("a", "b").alias("key"), "node", "x", F.lit(end == "a").alias("left")) for end in ("a", "b")]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, left, ids = matrix(group["x"]), group["left"].to_numpy(bool), group["node"].to_numpy()
        sims = a[left] @ a[~left].T
        i, j = np.unravel_index(int(sims.argmax()), sims.shape)
        linked = sims[i, j] >= cosine - 1e-9
        return pd.DataFrame({"a": ids[left][[i]], "b": ids[~left][[j]]}) if linked else pd.DataFrame({"a": [], "b": []})

    return sure.union(_groups(sides[0].union(sides[1]), "key", compare, "a long, b long"))


def joined(lists: DataFrame, nodes: DataFrame, cosine: float, whole: bool = False) -> DataFrame:
    """(id, root): the components that the lists' links and those between nodes with lists full of links make; with whole, those between all nodes."""
    least = cosine - MARGIN
    close = lists.where(F.col("sim") >= least).select(F.col("node").alias("a"), F.col("other").alias("b"))
    loose = settle(components(close))
    # a list that is full of links may have no place for those to another component; other lists hold all links of their nodes
    full = lists.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where((F.col("low") >= least) & (F.col("n") >= NEIGHBOURS)).select("node")
    if whole:
        alone = nodes.select("node", "x").join(loose.withColumnRenamed("id", "node"), "node", "left")
        members = alone.select(F.coalesce("root", "node").alias("root"), "node", "x")
    else:
        members = full.join(loose.withColumnRenamed("id", "node"), "node").join(nodes.select("node", "x"), "node").select("root", "node", "x")
    more = settle(cross_links(members, cosine))
    return settle(components(close.union(more))) if more.limit(1).count() else loose


def links_within(members: DataFrame, cosine: float) -> DataFrame:
    """(node, n, near) over members(root, node, copies, x): links of each node to a block of its component, and a node it is connected with there."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    rows = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    cells = F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(F.col("block"), j)), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: pair(i, F.col("block"))))))
    dealt = rows.select("root", "node", "copies", "x", "block", cells.alias("cell")).select(F.xxhash64("root", "cell.i", "cell.j").alias("key"), "node", "copies", "x", (F.col("block") == F.col("cell.i")).alias("left"), (F.col("block") == F.col("cell.j")).alias("right"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a = _unit(group["x"])
        left, right = group["left"].to_numpy(bool), group["right"].to_numpy(bool)
        ids, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        rows, columns = np.flatnonzero(left), np.flatnonzero(right)
        linked = a[rows] @ a[columns].T >= cosine
        linked &= ids[rows][:, None] != ids[columns][None, :]
        n = linked @ copies[columns]
        # a spanning set of links, for the components on exact links
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in np.flatnonzero(n):
            for c in columns[linked[r]]:
                p, q = root(int(ids[rows[r]])), root(int(ids[c]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
        near = [root(int(i)) if int(i) in parent else int(i) for i in ids[rows]]
        return pd.DataFrame({"node": ids[rows], "n": n, "near": near})

    return _groups(dealt, "key", compare, "node long, n long, near long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding).

    Equal vectors are one node. The neighbour graph starts from random-projection trees and is refined by joins of
    neighbours' neighbours; where a list is full of links it is enlarged. Links connect components; nodes whose lists are
    full are compared across components by clusters, so no link that leaves a full list is lost. An audit against brute
    force on a sample adds trees and rounds, EXTRA times at most; if recall is still short, all nodes are compared across
    components, which loses nothing but grows with the square of the clusters. In components all pairs are compared on doubles, block
    by block, which gives the links that full lists could not hold. None below cosine is a link.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Shorter vectors count as
    filled with zeros. A null vec_id takes no part in the search. Rows of one id and vector are copies of each other;
    other columns are ignored; an empty table gives no rows.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    nodes = settle(nodes_of(own.where("vec_id IS NOT NULL")))
    n = nodes.count()
    least = cosine - MARGIN
    trees = trees_for(depth_of(n), cosine)
    lists = settle(shortened(first_lists(nodes, n, trees, 1).withColumn("old", F.lit(False)), None))
    sizes = None
    for r in range(ROUNDS):
        lists = descend(lists, nodes, sizes)
    for r in range(EXTRA):
        full = lists.groupBy("node").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where((F.col("low") >= least) & (F.col("n") >= NEIGHBOURS) & (F.col("n") < LONGEST))
        full = settle(full.select("node", F.least(F.col("n") * 2, F.lit(LONGEST)).alias("k")))
        if not full.limit(1).count():
            break
        sizes = full
        lists = descend(lists, nodes, sizes)
    loose = joined(lists, nodes, cosine)
    for r in range(EXTRA + 1):
        if audit(loose, nodes, cosine) >= RECALL:
            break
        if r == EXTRA:  # the search is still short: compare everything
            loose = joined(lists, nodes, cosine, whole=True)
            break
        more = first_lists(nodes, n, trees, 2 + r).withColumn("old", F.lit(False))
        lists = descend(settle(shortened(lists.union(more), sizes)), nodes, sizes)
        loose = joined(lists, nodes, cosine)
    members = nodes.join(loose.withColumnRenamed("id", "node"), "node").select("root", "node", "copies", "x")
    found = settle(links_within(members, cosine))
    tight = components(found.select(F.col("node").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "node")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    per_node = nodes.select("node", "copies", "x").join(counts, "node", "left").join(tight, "node", "left").select(F.col("x").alias("_x"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = own.join(per_node, F.when(F.col("vec_id").isNotNull(), F.col("embedding")) == F.col("_x"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
