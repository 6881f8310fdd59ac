"""Operator 3: removal of passages that repeat anywhere in the corpus, by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import discard, settle, shorter, small_batches, tidy
from ._text import flat, pieces, prefix, span_hash
from .suffix import common_prefixes, suffix_array

#: A string of LENGTH bytes that starts in two places is a repeat. Its anchor is the GRAM bytes in it of smallest hash.
LENGTH, GRAM = 200, 64
#: A shard's suffix array is over about so many bytes.
SHARD = 1 << 19
#: An anchor with more different fragments is no shard: its strings are compared by their hashes, wherever they are.
FRAGMENTS = 2000
#: Anchors of a longer text are sought stretch by stretch, by where its strings start.
LONG = 1 << 23
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first start, last start, anchor, anchor hash and fragment hash of every fragment.

    Every string of length bytes has one anchor, the leftmost of its grams of smallest hash. The strings of a text that
    share an anchor start at neighbouring places; they and all their bytes are a fragment. Equal strings have equal
    anchors at equal places, so a string's copies are in fragments of the same anchor hash.
    """
    n, width = len(data), length - gram + 1
    if n - length + 1 > LONG and len(off) == 2:
        found = []
        for a in range(0, n - length + 1, LONG):
            part = data[a : a + LONG + length - 1]
            owner, start, stop, anchor, g, f = anchors(part, np.array([0, len(part)]), length, gram)
            found.append((owner, start + a, stop + a, anchor + a, g, f))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    none = np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    if n < length or not len(owner):
        return none, none, none, none, none, none
    sums = prefix(data)
    at = np.arange(n - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    key = (hashes & ~_LOW) | (at.astype(np.uint64) & _LOW)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: n - length + 1], key[width - span : width - span + n - length + 1])
    counts = np.maximum(np.diff(off) - length + 1, 0)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + off[:-1][owner]
    anchor = start + (((key[start] & _LOW).astype(np.int64) - start) & int(_LOW))
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([change[1:] - 1, [len(start) - 1]])
    a, b = start[change], start[last]
    return owner[change], a, b, anchor[change], hashes[anchor[change]].astype(np.int64), span_hash(sums, a, b + length).astype(np.int64)


def fragments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(raw, at, more, lead, g, f) for every fragment of docs(text): more + length bytes from byte at on, lead of them before the anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            raw = b.column("raw").to_numpy()
            for lo, hi in pieces(off):
                owner, start, stop, anchor, g, f = anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, gram)
                begin = (off[lo : hi + 1] - off[lo])[owner]
                yield pa.record_batch([pa.array(raw[lo:hi][owner]), pa.array((start - begin).astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array((anchor - start).astype(np.int32)), pa.array(g), pa.array(f)], ["raw", "at", "more", "lead", "g", "f"])

    return docs.select(F.xxhash64("text").alias("raw"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(tidy(find), "raw long, at int, more int, lead int, g long, f long")


def slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted(raw, at, more, lead, g, f, n) with bytes, the fragment's bytes; from one text where several are equal."""
    by_text = wanted.groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("at", "more", "lead", "g", "f", "n"))).alias("wanted"))  # as many as the text has fragments
    texts = docs.select(F.xxhash64("text").alias("raw"), "text").join(by_text, "raw")
    cut = F.explode("wanted").alias("w")
    raw_bytes = F.encode("text", "UTF-8")
    return texts.select("raw", raw_bytes.alias("_bytes"), cut).select("raw", "w.*", F.substring(F.col("_bytes"), F.col("w.at") + 1, F.col("w.more") + F.lit(length)).alias("bytes")).dropDuplicates(["g", "f"])


def promising(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Those parts that agree with another of their anchor on half of what a string has besides its anchor, on one side.

    A string that two fragments share reaches that far from the anchor before it or behind it.
    """
    half = (length - gram) // 2
    before = F.when(F.col("lead") >= half, F.xxhash64(F.lit(0), "g", F.substring(F.col("bytes"), F.col("lead") - half + 1, F.lit(half))))
    behind = F.when(F.octet_length("bytes") - F.col("lead") - gram >= half, F.xxhash64(F.lit(1), "g", F.substring(F.col("bytes"), F.col("lead") + gram + 1, F.lit(half))))
    sides = parts.select("g", "f", F.explode(F.array_compact(F.array(before, behind))).alias("side"))
    shared = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side")
    return parts.join(sides.join(shared, "side").select("g", "f").distinct(), ["g", "f"])


def _starts(parts: list[bytes], length: int) -> np.ndarray:
    """True for every byte, of all parts in a row with a byte between, at which a string begins that begins elsewhere too."""
    s = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    s[ends] = 0
    sa = suffix_array(s, 257)
    shared = common_prefixes(s, sa, length)[sa] >= length
    out = np.zeros(len(s), bool)
    out[sa[shared]] = True
    out[sa[np.flatnonzero(shared) - 1]] = True
    return out


def shard_repeats(parts: DataFrame, length: int, size: int = SHARD) -> DataFrame:
    """Rows (g, n, raw, at, more, bytes) to (raw, at, until): places of a text at which repeated strings start, where n is 1.

    Fragments of one anchor meet in one partition; whole anchors make up a shard, whose suffix array is built by induced
    sorting. A string repeats if its suffix shares length bytes with a neighbour; only strings inside a fragment count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = _starts([r[5] for r in held], length)
            rows, begin = [], 0
            for _, n, raw, at, _more, part in held:
                if n == 1:
                    hit = np.flatnonzero(np.diff(np.concatenate([[0], found[begin : begin + len(part) - length + 1].astype(np.int8), [0]])))
                    rows += [(raw, at + int(a), at + int(b)) for a, b in hit.reshape(-1, 2)]
                begin += len(part) + 1
            held.clear()
            r, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.record_batch([pa.array(r, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["raw", "at", "until"])

        total = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "n", "raw", "at", "more", "bytes")), strict=True):
                if held and total > size and row[0] != held[-1][0]:
                    yield done()
                    total = 0
                held.append(row)
                total += len(row[5])
        if held:
            yield done()

    return parts.select("g", "n", "raw", "at", "more", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(tidy(work), "raw long, at int, until int")


def hashed_repeats(parts: DataFrame, length: int) -> DataFrame:
    """As shard_repeats(), for anchors with very many different fragments: a row for each string, counted by its hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("bytes"))
            n, raw, at = b.column("n").to_numpy(), b.column("raw").to_numpy(), b.column("at").to_numpy()
            for lo, hi in pieces(off):
                o = off[lo : hi + 1] - off[lo]
                counts = np.diff(o) - length + 1
                owner = np.repeat(np.arange(hi - lo), counts)
                within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = o[:-1][owner] + within
                h = span_hash(prefix(data[off[lo] : off[hi]]), start, start + length).astype(np.int64)
                yield pa.record_batch([pa.array(h), pa.array(n[lo:hi][owner]), pa.array(raw[lo:hi][owner]), pa.array((at[lo:hi][owner] + within).astype(np.int32))], ["h", "n", "raw", "at"])

    rows = parts.select("n", "raw", "at", "bytes").mapInArrow(tidy(strings), "h long, n long, raw long, at int")
    often = rows.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
    return rows.where("n = 1").join(often, "h").select("raw", "at", (F.col("at") + 1).alias("until"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = FRAGMENTS) -> DataFrame:
    """(raw, at, until): for each text, named by its hash, the byte places at which repeated strings start."""
    with small_batches(docs.sparkSession):
        rows = settle(fragments(docs, length, gram))
    often = settle(rows.groupBy("g").agg(F.count("*").alias("n_g"), (F.min("f") != F.max("f")).alias("mixed")).where("n_g > 1"))
    known = settle(rows.join(often, "g").select("raw", "at", "more", "lead", "g", "f", "mixed"))
    discard(rows)
    same = known.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(F.struct("raw", "at", "more", "lead")).alias("one"), F.first("mixed").alias("mixed"))
    same = settle(same.select("g", "f", "n", "one.*", "mixed"))
    whole = known.join(same.where("n > 1").select("g", "f"), ["g", "f"]).select("raw", "at", (F.col("at") + F.col("more") + 1).alias("until"))
    doubtful = same.where("mixed").groupBy("g").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1")
    parts = settle(slices(docs, same.where("mixed").join(doubtful.select("g"), "g").select("raw", "at", "more", "lead", "g", "f", "n"), length).join(doubtful.select("g", "kinds"), "g"))
    parts = settle(promising(parts, length, gram))
    out = whole.union(shard_repeats(parts.where(F.col("kinds") <= most), length, shard))
    if doubtful.where(F.col("kinds") > most).limit(1).count():
        out = out.union(hashed_repeats(parts.where(F.col("kinds") > most), length))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, most: int = FRAGMENTS) -> DataFrame:
    """docs with kept (binary: the bytes that stay), removed (array of (start, end) in bytes, maximal) and n_bytes.

    A byte goes if a string of length bytes covers it that starts in two places at least, of one text or of two, in all
    of docs as given. Null text is empty; shorter texts stay as they are; equal texts go whole, as each is a copy of the
    other. Ids may be null or repeat; columns named like an added one are replaced, others stay; an empty table gives no
    rows. Texts are named by a 64-bit hash while their places are counted.
    """
    docs = docs.drop("kept", "removed", "n_bytes")
    starts = repeated_starts(docs, length, gram, shard, most)
    by_text = starts.groupBy(F.col("raw").alias("_raw")).agg(F.collect_set(F.struct("at", "until")).alias("_starts"))  # as many as the text has fragments
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(by_text, F.col("_hash") == F.col("_raw"), "left").drop("_hash", "_raw")
    columns = list(docs.columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shorter(batches):
            texts, starts = b.column("text").cast(pa.binary()), b.column("_starts").to_pylist()
            kept, removed, size = [], [], []
            for i, runs in enumerate(starts):
                raw = texts[i].as_py() or b""
                size.append(len(raw))
                spans: list[list[int]] = []
                for r in sorted(runs or (), key=lambda r: r["at"]):
                    begin, end = r["at"], r["until"] - 1 + length
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([begin, end])
                out, at = [], 0
                for begin, end in spans:
                    out.append(raw[at:begin])
                    at = end
                kept.append(b"".join([*out, raw[at:]]))
                removed.append([{"start": x, "end": y} for x, y in spans])
            at = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([*(b.column(c) for c in columns), pa.array(kept, pa.binary()), pa.array(removed, at), pa.array(size, pa.int64())], [*columns, "kept", "removed", "n_bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(tidy(remove), f"{schema}, kept binary, removed array<struct<start:bigint,end:bigint>>, n_bytes bigint")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
