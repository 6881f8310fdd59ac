"""Operator 1: near-duplicates by DartMinHash signatures, banding and an exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import components, settle, small_batches, tidy
from ._text import distinct, flat, mix, pieces, shingles, words

WIDTH, SIMILARITY = 5, 0.8
#: 25 bands of 5 coordinates: texts of similarity 0.8 share a band with probability 0.99995.
BANDS, ROWS = 25, 5
#: Signatures that agree on a smaller share than this are no candidates: 4.5 standard deviations below 0.8.
ESTIMATE = 0.64
#: A bucket with more texts is split by a second band, and where that is not enough by two seeded hashes.
BUCKET = 256
#: Candidate groups up to so many texts, whose shingles have so many bytes, are compared exactly in one task; larger ones by joins.
GROUP, GROUP_BYTES = 1000, 32 << 20

_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.int64)


def darts(element: np.ndarray, owner: np.ndarray, weight: np.ndarray | None, n: int, k: int, seed: int = 1) -> np.ndarray:
    """DartMinHash signatures (n, k) of weighted sets given as (element, owner, weight) rows; weight None: all weigh 1.

    Over every element lies a plane of weight by rank. Hashes throw darts on its unit cells, one a cell on average; a
    dart that lies below the element's weight belongs to the set and has a coordinate. A coordinate of the signature is
    the rank of its earliest dart. About k ln k + 2k darts fill all coordinates, whatever the number of elements; where
    one stays empty the search goes on to higher ranks, so every coordinate is that of the whole plane. A set without
    elements has the highest number in all coordinates. Two sets agree in a coordinate with probability their weighted
    Jaccard similarity. An element given twice with weight 1 counts once.
    """
    none = np.uint64(2**64 - 1)
    out = np.full((n, k), none, np.uint64)
    if not len(element):
        return out
    mass = np.bincount(owner, weight, minlength=n)
    height = np.ceil((k * math.log(k) + 2 * k) / np.maximum(mass, 1e-9)).astype(np.int64)
    low, high = np.zeros(n, np.int64), np.minimum(height, 1 << 20)
    base = mix(element + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    rows = np.arange(len(element))
    flat_out = out.reshape(-1)
    while len(rows):
        tall = high[owner[rows]] - low[owner[rows]]
        wide = np.ones(len(rows), np.int64) if weight is None else np.ceil(weight[rows]).astype(np.int64)
        cells = tall * wide
        stop = np.cumsum(cells)
        a = 0
        while a < len(rows):  # some rows at a time: memory stays bounded
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + 400_000, "right")))
            r = np.repeat(rows[a:b], cells[a:b])
            j = np.arange(len(r)) - np.repeat(np.concatenate([[0], np.cumsum(cells[a:b])[:-1]]), cells[a:b])
            w_cell = 0 if weight is None else j // np.repeat(tall[a:b], cells[a:b])
            rank = low[owner[r]] + (j if weight is None else j % np.repeat(tall[a:b], cells[a:b]))
            cell = mix(base[r] ^ (rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(w_cell) * np.uint64(0x165667B19E3779F9) if weight is None else rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + w_cell.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
            hits = _POISSON[(cell >> np.uint64(48)).astype(np.int64)]
            d = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
            one = mix(np.repeat(cell, hits) + (d + 1).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
            r, rank = np.repeat(r, hits), np.repeat(rank, hits)
            if weight is not None:
                at = np.repeat(w_cell, hits) + (one >> np.uint64(40)).astype(np.float64) / 2**24
                keep = at < weight[r]
                one, r, rank = one[keep], r[keep], rank[keep]
            value = (rank.astype(np.uint64) << np.uint64(32)) | (one & np.uint64(0xFFFFFFFF))
            coordinate = (mix(one) % np.uint64(k)).astype(np.int64)
            np.minimum.at(flat_out, owner[r] * k + coordinate, value)
            a = b
        unfilled = (out == none).any(1)
        rows = rows[unfilled[owner[rows]]]
        low, high = high, high * 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band of rows coordinates."""
    n, k = signature.shape
    h = np.zeros((n, k // rows), np.uint64) + np.arange(k // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        h = mix(h ^ (signature[:, r : k // rows * rows : rows] + np.uint64(0x632BE59BD9B4E019)))
    return h


def fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of all words of each text, in their order."""
    begin = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(begin, counts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return mix(sums[begin + counts] - sums[begin] + counts.astype(np.uint64))


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, off = flat(pc.utf8_lower(batch.column("text")))
    for lo, hi in pieces(off):
        yield lo, hi, *words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def signatures(docs: DataFrame, k: int = BANDS * ROWS, width: int = WIDTH, weights: str = "set") -> DataFrame:
    """docs(doc_id, text) as (doc_id, raw, node, sketch, bands): node names the text's words, sketch holds a byte a coordinate.

    weights "set" gives every distinct shingle weight 1, "count" its number of occurrences.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sketch, keys = [], [], []
            for lo, hi, h, owner, counts in _hashed(b):
                node.append(np.where(counts > 0, fingerprint(h, counts), np.uint64(0)).astype(np.int64))
                s, own = shingles(h, owner, counts, width)
                weight = None
                if weights == "count":
                    order = np.lexsort((s, own))
                    s, own = s[order], own[order]
                    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (own[1:] != own[:-1])])) if len(s) else np.zeros(0, np.int64)
                    weight = np.diff(np.concatenate([first, [len(s)]])).astype(float)
                    s, own = s[first], own[first]
                sig = darts(s, own, weight, hi - lo, k)
                sketch.append((mix(sig) >> np.uint64(56)).astype(np.uint8))
                keys.append(bands(sig).astype(np.int64))
            node = np.concatenate(node) if node else np.zeros(0, np.int64)
            sketch = np.concatenate(sketch) if len(sketch) else np.zeros((0, k), np.uint8)
            keys = np.concatenate(keys) if len(keys) else np.zeros((0, k // ROWS), np.int64)
            yield pa.record_batch([
                b.column("doc_id").cast(pa.int64()), b.column("raw").cast(pa.int64()), pa.array(node),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(sketch), [None, pa.py_buffer(np.ascontiguousarray(sketch).tobytes())]).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))],
                ["doc_id", "raw", "node", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(sign), "doc_id long, raw long, node long, sketch binary, bands array<long>")


def _forest(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes: for each bucket a spanning forest of the highest estimates, of those that reach ESTIMATE."""
    n, found = len(key), []
    rows = np.arange(n - 1)
    lag = 1
    while True:
        rows = rows[rows + lag < n]
        rows = rows[key[rows] == key[rows + lag]] if len(rows) else rows
        if not len(rows):
            break
        for part in np.array_split(rows, len(rows) // 50_000 + 1):
            estimate = (sketch[part] == sketch[part + lag]).sum(1)
            good = estimate >= ESTIMATE * sketch.shape[1]
            found.append(np.column_stack([estimate[good], part[good], part[good] + lag]))
        lag += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for _, i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            kept.append((i, j))
    at = np.array(kept, np.int64).reshape(-1, 2)
    return node[at[:, 0]], node[at[:, 1]]


def candidate_links(buckets: DataFrame) -> DataFrame:
    """Rows (bucket, node, sketch) to candidate pairs (a, b). Buckets meet in partitions and are read one after the other."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
            a, b = _forest(rows["bucket"].to_numpy(), rows["node"].to_numpy(), sketch)
            return pd.DataFrame({"a": a, "b": b})

        for rows in batches:
            if not len(rows):
                continue
            kept.append(rows)
            last = rows["bucket"].iloc[-1]
            if kept[0]["bucket"].iloc[0] != last:
                rows = pd.concat(kept, ignore_index=True)
                edge = int(np.searchsorted((rows["bucket"] == last).to_numpy(), True))
                kept = [rows.iloc[edge:]]
                yield done(rows.iloc[:edge])
        if kept:
            yield done(pd.concat(kept, ignore_index=True))

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(tidy(scan), "a long, b long")


def _split(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets with 2 to chunk nodes, and rows of larger ones with their n."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(counts, "bucket")
    return sized.where(F.col("n") <= chunk).drop("n"), sized.where(F.col("n") > chunk)


def _exact(group: pd.DataFrame, similarity: float) -> list[int]:
    """For each row of a group the place of the first row it is connected with by links of at least similarity."""
    sets = [np.frombuffer(x, "<i8") for x in group["shingles"]]
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.zeros(0), np.zeros(0, np.int64))
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    begin = np.searchsorted(place[order], np.arange(len(values) + 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        mine = place[at[i] : at[i + 1]]
        low, size = begin[mine], begin[mine + 1] - begin[mine]
        take = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.bincount(owner[take], minlength=n)
        for j in np.flatnonzero(common >= similarity * (sizes[i] + sizes - common) - 1e-9):
            if j != i and common[j]:
                a, b = root(i), root(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, group, shingles) for the rows (doc_id, raw, node, group) of nodes; shingles: distinct hashes as 64-bit numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo, hi, h, owner, counts in _hashed(b):
                s, own = shingles(h, owner, counts, width)
                edge = np.searchsorted(own, np.arange(hi - lo + 1))
                out += [distinct(s[edge[i] : edge[i + 1]]).astype("<i8").tobytes() for i in range(hi - lo)]
            yield pa.record_batch([b.column("node"), b.column("group"), pa.array(out, pa.binary())], ["node", "group", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("raw", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(nodes["doc_id"]) & (rows["raw"] == nodes["raw"])
    return rows.join(nodes, same).select("node", "group", "text").mapInArrow(tidy(gather), "node long, group long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sets have the similarity."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(tidy(check), "a long, b long")


def stray_links(sets: DataFrame, roots: DataFrame, similarity: float, block: int, block_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links (a, b) between the classes of a group, of which each node has one to every class it is linked with.

    sets(node, group, shingles, bytes), roots(node, root). A link between two classes has an end outside the group's largest
    one. These strays are compared with all nodes of their group, exactly, in cells of block strays by block nodes, or
    fewer where their shingles have many bytes; a cell counts common shingles by inverted lists and gives out links only.
    """
    known = sets.select("node", "group", "bytes").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = known.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("bytes").alias("heavy"))
    known = known.drop("bytes").join(main, "group").where(F.col("all") > F.col("most"))
    rows = sets.select("node", "shingles").join(known, "node")
    blocks = lambda n: F.greatest(F.ceil(n / block), F.ceil(F.col("heavy") / block_bytes)).cast("int")
    hashed = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    strays = F.col("all") - F.col("most")
    left = rows.where("root <> main").select("group", hashed(strays).alias("i"), every(F.col("all")).alias("j"), "node", "root", "shingles")
    right = rows.select(F.col("group").alias("g"), every(strays).alias("k"), hashed(F.col("all")).alias("l"), F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("shingles").alias("other_shingles"))

    def cell(strays: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        a = [np.frombuffer(x, "<i8") for x in strays["shingles"]]
        b = [np.frombuffer(x, "<i8") for x in others["other_shingles"]]
        found: list[tuple[int, int]] = []
        if a and b:
            size = np.array([len(x) for x in b])
            flat_ = np.concatenate(b)
            order = np.argsort(flat_, kind="stable")
            values, owner = flat_[order], np.repeat(np.arange(len(b)), size)[order]
            root_of, node_of = others["other_root"].to_numpy(), others["other"].to_numpy()
            for node, root, x in zip(strays["node"], strays["root"], a, strict=True):
                low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                n = high - low
                take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[take], minlength=len(b))
                near = np.flatnonzero((common > 0) & (common >= similarity * (len(x) + size - common) - 1e-9) & (root_of != root))
                for j in np.unique(root_of[near], return_index=True)[1]:
                    found.append((int(node), int(node_of[near[j]])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.groupBy("group", "i", "j").cogroup(right.groupBy("g", "k", "l")).applyInPandas(cell, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row (doc_id, raw, class_id, kept) for each row of docs(doc_id, text); raw is the hash of the text.

    Two texts are linked if the Jaccard similarity of their sets of shingles (five words, lower case, letters and digits
    only; fewer words: one shingle) is at least similarity; a class is what links connect, and class_id its smallest
    doc_id. Texts with the same words are one node, so copies cost one row each. DartMinHash signatures are cut into
    bands, nodes that share a band are in one bucket, and each bucket gives a spanning forest of its highest estimates:
    by the cut property it connects whatever a threshold connects. Buckets over bucket nodes are split by a second band.
    Groups that candidates connect are compared exactly: up to group nodes and group_bytes of shingles in one task; in larger ones first the
    forests' pairs, then the nodes outside the largest class that these leave, against all nodes of the group in blocks.

    Null, empty and wordless texts are a class each, except that equal wordless texts share one. A null doc_id is a
    member; a class of null ids has class_id null. kept: one row of each class, that of the smallest doc_id, of null ids
    that of the smallest raw; equal rows are kept alike. Other columns are ignored; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        sig = settle(signatures(docs))

    per_node = sig.where("node <> 0").groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.min_by("sketch", "raw").alias("sketch"), F.min_by("bands", "raw").alias("bands"))
    nodes = settle(per_node.select("node", "first.doc_id", "first.raw", "sketch", "bands"))
    rows = nodes.select("node", "sketch", "bands", F.explode("bands").alias("bucket"))
    few, many = _split(rows.select("node", "bucket"), bucket)
    many = settle(many)
    sketches = nodes.select("node", "sketch")
    parts = [few]
    if many.limit(1).count():
        second = many.join(nodes.select("node", "bands"), "node").withColumn("_at", F.array_position("bands", F.col("bucket")).cast("int"))
        deeper = second.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.xxhash64("bucket", F.element_at("bands", ((F.col("_at") + i * 7) % BANDS + 1).cast("int"))))).alias("bucket"))
        small, large = _split(deeper, bucket)
        parts.append(small)
        for seed in (1, 2):
            chunk = F.pmod(F.xxhash64(F.lit(seed), "node"), F.ceil(F.col("n") / (bucket // 2)))
            parts.append(large.select("node", F.xxhash64("bucket", F.lit(seed), chunk).alias("bucket")))
    members = parts[0].select("node", "bucket")
    for p in parts[1:]:
        members = members.union(p.select("node", "bucket"))
    pairs = settle(candidate_links(members.join(sketches, "node").select("bucket", "node", "sketch")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loose = settle(components(pairs))
    grouped = loose.withColumnRenamed("root", "group").join(nodes.select(F.col("node").alias("id"), "doc_id", "raw"), "id").withColumnRenamed("id", "node")
    with small_batches(docs.sparkSession):
        sets = settle(shingle_sets(docs, grouped.select("doc_id", "raw", "node", "group")).dropDuplicates(["node"]).withColumn("bytes", F.octet_length("shingles").cast("long")))
    heavy = settle(sets.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > group) | (F.col("bytes") > group_bytes)).select("group"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        first = _exact(rows, similarity)
        return pd.DataFrame({"node": rows["node"], "root": rows["node"].to_numpy()[first]})

    exact = sets.join(heavy, "group", "left_anti").groupBy("group").applyInPandas(compare, "node long, root long")
    if heavy.limit(1).count():
        big = sets.join(heavy, "group", "left_semi")
        links = settle(verified(pairs, big, similarity))
        roots = settle(components(links).withColumnRenamed("id", "node"))
        more = settle(stray_links(big, roots, similarity, group, group_bytes))
        if more.limit(1).count():
            roots = components(links.union(more)).withColumnRenamed("id", "node")
        exact = exact.union(roots.select("node", "root"))
    exact = settle(exact)
    class_of_node = sig.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("raw").alias("first")).join(exact, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = class_of_node.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("first"))
    ids = class_of_node.drop("first").join(least, "root").select("node", "class_id", "first")
    with_words = sig.where("node <> 0").join(ids, "node").select("doc_id", "raw", "class_id", "first")
    empty = F.xxhash64(F.lit(""))
    blank = sig.where("node = 0")
    same = blank.groupBy("raw").agg(F.min("doc_id").alias("_least"))
    nothing = (F.col("raw") == empty) | (F.col("raw") == F.xxhash64(F.lit(None).cast("string")))
    rest = blank.join(same, "raw").select("doc_id", "raw", F.when(nothing, F.col("doc_id")).otherwise(F.col("_least")).alias("class_id"), F.col("raw").alias("first"))
    kept = F.when(F.col("class_id").isNull(), F.col("raw") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id")))
    return with_words.union(rest).withColumn("kept", kept).drop("first")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One row of docs, with all its columns, for each class of near_duplicates()."""
    keep = near_duplicates(docs, **how).where("kept").groupBy("class_id", "doc_id", F.when(F.col("doc_id").isNull(), F.col("raw"))).agg(F.min("raw").alias("raw")).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"))
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    met = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["_hash"] == keep["_raw"]))
    return met.dropDuplicates(["_id", "_raw"]).select(*docs.columns)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "kept")
