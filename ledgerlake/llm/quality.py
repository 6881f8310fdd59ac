"""Operator 2: interpolated modified Kneser-Ney models of character n-grams of trusted text; perplexity against quantiles by language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import ROWS_PER_BATCH, discard, give_back, settle, small_batches, tidy
from ._text import distinct, flat, grouped, mix, pieces

#: N-grams of ORDER symbols. A symbol is a code point; white space and controls are one symbol, and 0 stands before the text.
ORDER = 6
#: Below the unigrams every code point of Unicode is as probable as any other.
CODE_POINTS = 0x110000
#: A share of the trusted texts is held out of the counts and sets the thresholds.
HELD_OUT_OF_10 = 2
#: A language without bad labels has this quantile of its held-out perplexities for threshold.
QUANTILE = 0.99
#: Elsewhere labels choose the quantile, on the logarithms of perplexities in bins of one in so many.
BINS = 1000
#: A text counts as if it had so many more symbols of its language's mean surprise, so short texts are not judged on little.
PRIOR = 40
#: Above so many trusted ids a shuffle join takes the place of the broadcast.
BROADCAST_IDS = 2_000_000
#: Texts of about so many bytes are a block: its different n-grams are asked for once. A task holds a block compressed and its n-grams.
BLOCK = 64 << 20
#: The model is cut by hash into shards of about so many n-grams, and a shard answers so many blocks in one task.
SHARD_ROWS, BLOCKS_PER_TASK = 500_000, 256
#: A task counts so many different n-grams before it passes them on, in batches of so many rows.
HELD_GRAMS, GRAMS_PER_BATCH = 1_200_000, 1 << 16
_STEPS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def lang_code(c: Column) -> Column:
    """64 bits that name a language; null is one."""
    return F.xxhash64(c.isNull(), c)


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row and the number of each text's. What is not UTF-8 counts as U+FFFD, as Python replaces it text by text."""
    raw, begins = data.tobytes(), (data & 0xC0) != 0x80
    first = off[:-1][off[:-1] < off[1:]]
    try:
        if not begins[first].all():
            raise UnicodeDecodeError("utf-8", raw, 0, 1, "a text begins within a character")
        chars, n = raw.decode().encode("utf-32-le"), np.diff(np.concatenate([[0], np.cumsum(begins)])[off])
    except UnicodeDecodeError:
        each = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        chars, n = b"".join(each), np.array([len(e) // 4 for e in each], np.int64)
    chars = np.frombuffer(chars, np.uint32)
    return np.where(chars <= 32, np.uint32(32), chars), n


def windows(sym: np.ndarray, n: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """Column by column, the last first, the n-grams that end at each symbol; 0 before a text's first."""
    place = np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)
    yield sym
    for k in range(1, order):
        back = np.zeros_like(sym)
        back[k:] = sym[: max(len(sym) - k, 0)]
        back[place < k] = 0
        yield back


def gram_hash(columns: Iterator[np.ndarray], code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram and its language; columns as windows() gives them."""
    h = code.astype(np.uint64)
    for step, c in zip(_STEPS, columns, strict=False):
        h = h + (c.astype(np.uint64) + np.uint64(1)) * step
    return mix(h)


def as_strings(grams: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = np.select([grams < 0x80, grams < 0x800, grams < 0x10000], [1, 2, 3], 4).sum(1)
    data = grams.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(grams), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Parts (hash, rest..., count) as one in which every hash stands once, with the sum of its counts."""
    columns = list(zip(*held, strict=True))
    held.clear()
    order, begin = grouped(np.concatenate(columns[0]))
    first, out = order[begin], []
    while len(columns) > 1:  # one column at a time: memory stays bounded
        out.append(np.concatenate(columns.pop(0))[first])
    return [*out, np.add.reduceat(np.concatenate(columns[0])[order], begin)]


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(code, gram, c): every n-gram of docs(text, code, taught) and how often the texts with taught have it. Sums within tasks first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            code, gram, c = part[1:]
            part.clear()
            near = np.zeros(len(gram), np.uint64)  # n-grams that begin alike stand together, which shuffle files store in less
            for k in range(min(4, gram.shape[1])):
                near = near << np.uint64(16) | gram[:, k].astype(np.uint64) & np.uint64(0xFFFF)
            order = np.argsort(near)
            del near
            for a in range(0, len(order), GRAMS_PER_BATCH):  # strings of all at once would take more memory than the counts
                some = order[a : a + GRAMS_PER_BATCH]
                yield pa.record_batch([pa.array(code[some]), as_strings(gram[some]), pa.array(c[some])], ["code", "gram", "c"])

        fresh = 0
        for b in batches:
            data, off = flat(b.column("text"))
            code, taught = b.column("code").to_numpy(), b.column("taught").to_numpy(zero_copy_only=False)
            for lo, hi in pieces(off):
                sym, n = symbols(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if not len(sym):
                    continue
                columns, own = list(windows(sym, n)), np.repeat(code[lo:hi], n)
                key = gram_hash(columns, own)
                order, begin = grouped(key)
                first = order[begin]
                times = np.add.reduceat(np.repeat(taught[lo:hi], n)[order], begin, dtype=np.int64)
                held.append([key[first], own[first], np.column_stack([c[first] for c in reversed(columns)]), times])
                fresh += len(first)
                del columns, own, key, order, first, times
                if fresh > HELD_GRAMS // 2:
                    fresh = 0
                    held.append(_merged(held))
                    if len(held[0][0]) > HELD_GRAMS * 5 // 4:
                        yield from out(held.pop())
        if held:
            yield from out(_merged(held))

    return docs.select("text", "code", "taught").mapInArrow(tidy(gather), "code long, gram string, c long").groupBy("code", "gram").agg(F.sum("c").alias("c"))


def suffix(k: int) -> Column:
    """The last k symbols of gram."""
    return F.expr(f"right(gram, {k})")


def context(k: int) -> Column:
    """The first k - 1 symbols of gram, which has k."""
    return F.expr(f"left(gram, {k - 1})")


def discounts_of(counts: DataFrame) -> DataFrame:
    """(code, d1, d2, d3), settled: each language's discounts, from how many of its n-grams(code, c) have each small count."""
    n = counts.groupBy("code").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)])
    y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when(F.col(f"n{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.1)), F.lit(i - 0.05))).otherwise(0.5) for i in (1, 2, 3)]
    return settle(n.select("code", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)]))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, gram, logp) for every row of grams(code, gram, c), settled: counts of each order are sharded by n-gram and joined order by order."""
    rows = {order: grams}
    for k in range(order - 1, 0, -1):  # how many different symbols the taught texts have before each shorter n-gram
        rows[k] = settle(rows[k + 1].groupBy("code", suffix(k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("int")).alias("c")))
    lower, d, c = None, [F.col(f"d{i}") for i in (1, 2, 3)], F.col("c")
    for k in range(1, order + 1):
        found = discounts_of(rows[k])
        counted = rows[k].join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "code")
        discount = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        contexts = counted.where("c > 0").groupBy("code", context(k).alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("left"))
        asked = counted.withColumn("context", context(k)).join(contexts, ["code", "context"], "left")
        if lower is None:
            asked = asked.withColumn("below", F.lit(1.0 / CODE_POINTS))
        else:
            asked = asked.withColumn("short", suffix(k - 1)).join(lower, ["code", "short"])
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((F.greatest(c - discount, F.lit(0.0)) + F.col("left") * F.col("below")) / F.col("total"))
        below = lower
        if k == order:
            model = settle(asked.select("code", "gram", F.log(p).cast("float").alias("logp")))
        else:  # each order is a query of its own: its shuffle files go, and no plan holds them all
            lower = settle(asked.select("code", F.col("gram").alias("short"), p.alias("below")))
            discard(rows[k])
        if below is not None:
            discard(below)
        discard(found)
    return model


def hashed_model(model: DataFrame) -> DataFrame:
    """model(code, gram, logp) as (key, logp): key is the hash that tasks make of the n-grams of texts."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, _ = flat(b.column("gram"))
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, ORDER), np.uint32)
            yield pa.record_batch([pa.array(gram_hash(points.T[::-1], b.column("code").to_numpy()).astype(np.int64)), b.column("logp")], ["key", "logp"])

    return model.mapInArrow(tidy(name), "key long, logp float")


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", 3)


def packed(a: np.ndarray) -> bytes:
    """An array of numbers, byte by byte of all of them, compressed."""
    flat_ = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return len(flat_).to_bytes(8, "little") + _zstd().compress(flat_, asbytes=True)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    size, wide = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = _zstd().decompress(b[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, rows): the rows of docs, of one block each, as compressed Arrow streams. A row's block is a hash of its text and doc_id."""
    ids = [F.col(c) for c in ("doc_id",) if c in docs.columns]
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("text", *ids), F.lit(blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            place, rows = rows.column("_block").to_numpy(), rows.drop_columns("_block")
            held.clear()
            at = np.argsort(place, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(place[at])) + 1):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=_zstd())) as w:
                    w.write_table(rows.take(pa.array(part)))
                yield pa.record_batch([pa.array([place[part[0]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > BLOCK // 4:
                yield from out()
                size = 0
        if held:
            yield from out()

    return dealt.mapInArrow(tidy(pack), "block int, rows binary")


def _texts(streams: pa.ChunkedArray) -> Iterator[tuple[pa.Table, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Table by table of a block, with (first row, last row, n-gram hashes, symbols of each text) piece by piece."""

    def parts(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        data, off = flat(t.column("text").combine_chunks())
        code = t.column("code").to_numpy()
        for lo, hi in pieces(off):
            sym, n = symbols(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield lo, hi, gram_hash(windows(sym, n), np.repeat(code[lo:hi], n)), n

    for s in streams:
        t = pa.ipc.open_stream(s.as_buffer()).read_all().combine_chunks()
        yield t, parts(t)


def score(docs: DataFrame, model: DataFrame, keep: list[str] | None = None, block: int = BLOCK, shard_rows: int = SHARD_ROWS, blocks_per_task: int = BLOCKS_PER_TASK) -> DataFrame:
    """docs(text, code, ...), of these the columns to keep, with surprise (the sum of -log p over the text's symbols) and symbols; model is hashed_model(), settled, of at least these texts.

    Texts are dealt to blocks. The different n-grams of a block are asked for once, shard by shard of the model; the
    answers, in the order of the n-grams' hashes, meet the block's texts and are summed text by text. What moves is the
    texts, compressed, once, the different n-grams of every block, and a number for each of them back. No task holds more than a shard, a block's n-grams and its
    compressed texts; rows that agree in text and doc_id are of one block.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, -(-size // block))
    shards, salts = max(1, -(-model.count() // shard_rows)), -(-blocks // blocks_per_task)
    shard_of = lambda key: ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    rows = blocked(docs, blocks)

    def different(streams: pa.ChunkedArray) -> np.ndarray:
        held: list[np.ndarray] = [np.zeros(0, np.uint64)]
        for _, parts in _texts(streams):
            for _, _, h, _ in parts:
                held.append(distinct(h))
                if sum(map(len, held[1:])) > max(len(held[0]), HELD_GRAMS // 2):
                    held = [distinct(np.concatenate(held))]
        return distinct(np.concatenate(held))

    def ask(key: tuple, block: pa.Table) -> pa.Table:
        all_ = different(block.column("rows"))
        edge = np.searchsorted(shard_of(all_), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(edge))
        deltas = [packed(np.diff(all_[edge[s] : edge[s + 1]], prepend=np.uint64(0))) for s in some]
        mine = key[0].as_py()
        del all_
        give_back()
        return pa.table([pa.array(some, pa.int32()), pa.array([mine % salts] * len(some), pa.int32()), pa.array([mine] * len(some), pa.int32()), pa.array(deltas, pa.binary())], ["shard", "salt", "asker", "keys"])

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        names, logp = known.column("key").to_numpy().view(np.uint64), known.column("logp").to_numpy()
        order = np.argsort(names)
        names, logp = names[order], logp[order]
        out = []
        for k in asked.column("keys"):
            want = np.cumsum(unpacked(k.as_buffer().to_pybytes(), np.uint64), dtype=np.uint64)
            at = np.searchsorted(names, want)
            if len(names) == 0 or (names[np.minimum(at, len(names) - 1)] != want).any():
                raise ValueError("the model lacks n-grams of the texts")
            out.append(packed(logp[at]))
        del names, logp, order
        give_back()
        return pa.table([asked.column("asker"), asked.column("shard"), pa.array(out, pa.binary())], ["asker", "part", "logp"])

    asked = rows.groupBy("block").applyInArrow(ask, "shard int, salt int, asker int, keys binary")
    top = F.shiftrightunsigned("key", 32)
    known = model.select("key", "logp", F.shiftright(top * F.lit(shards), 32).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("t"))
    answers = asked.groupBy("shard", "salt").cogroup(known.groupBy("s", "t")).applyInArrow(answer, "asker int, part int, logp binary")
    names = docs.columns if keep is None else keep

    def add(texts: pa.Table, said: pa.Table) -> pa.Table:
        said = said.sort_by("part")
        logp = np.concatenate([np.zeros(0, np.float32), *(unpacked(v.as_buffer().to_pybytes(), np.float32) for v in said.column("logp"))])
        table = Lookup(different(texts.column("rows")).view(np.int64), logp)
        del said, logp
        give_back()
        out = []
        for t, parts in _texts(texts.column("rows")):
            total, count = np.zeros(t.num_rows), np.zeros(t.num_rows, np.int64)
            for lo, hi, h, n in parts:
                sums = np.concatenate([[0.0], np.cumsum(table.get(h.view(np.int64)), dtype=np.float64)])
                at = np.concatenate([[0], np.cumsum(n)])
                total[lo:hi], count[lo:hi] = sums[at[:-1]] - sums[at[1:]], n
            t = t.select(names).append_column("surprise", pa.array(total)).append_column("symbols", pa.array(count))
            out += t.to_batches(ROWS_PER_BATCH)
        del table
        give_back()
        return pa.Table.from_batches(out)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(add, f"{schema}, surprise double, symbols long")


class Lookup:
    """A hash table of 64-bit keys in two arrays, filled and asked a whole array at a time."""

    EMPTY = np.int64(-1)

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(1.5 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY, np.int64), np.zeros(1 << bits, np.float32)
        todo, at = np.arange(len(key)), self.place(key)
        while len(todo):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = key[todo[free]]
            mine = free & (self.keys[at] == key[todo])
            self.values[at[mine]] = value[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & self.mask

    def place(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values, 0 for keys that are not in the table."""
        at, out = self.place(key), np.zeros(len(key), np.float32)
        got = self.keys[at]
        same = got == key
        out[same] = self.values[at[same]]
        todo = np.flatnonzero(~same & (got != self.EMPTY))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got, want = self.keys[at], key[todo]
            same = got == want
            out[todo[same]] = self.values[at[same]]
            more = ~same & (got != self.EMPTY)
            todo, at = todo[more], at[more]
        return out


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with code (of the language), trusted, taught (trusted and not held out) and poor (labelled bad and not good)."""
    ids = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality"))
    ids = settle(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, F.col("doc_id") == F.col("_labelled"), "left")
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10))
    trusted, poor = (F.coalesce(F.col("_quality") == q, F.lit(False)) for q in (1, 0))
    return rows.select(*docs.columns, lang_code(F.col("lang")).alias("code"), trusted.alias("trusted"), (trusted & F.coalesce(fold >= HELD_OUT_OF_10, F.lit(False))).alias("taught"), poor.alias("poor"))


def cuts_of(rows: DataFrame) -> DataFrame:
    """(lang, threshold) from rows(lang, perplexity, poor): held-out trusted texts and texts labelled bad.

    The cut at which the share of held-out texts above and of bad texts not above are least together, in the middle of
    the gap where it is; without bad texts the QUANTILE of the held-out ones. A language without held-out texts has none.
    """
    binned = rows.groupBy("lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.sum((~F.col("poor")).cast("int")).alias("good"), F.sum(F.col("poor").cast("int")).alias("bad"))
    whole, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("bin")  # bins, a bounded number for each language
    lost = 1 - F.sum("good").over(order) / F.sum("good").over(whole)
    passed = F.sum("bad").over(order) / F.sum("bad").over(whole)
    at = (F.col("bin") + 1 + F.coalesce(F.lead("bin").over(order), F.col("bin") + 1)) / (2 * BINS)
    placed = binned.select("lang", "bin", at.alias("at"), F.sum("good").over(whole).alias("_good"), F.sum("bad").over(whole).alias("_bad"), F.sum("good").over(order).alias("_upto"), F.when(F.sum("bad").over(whole) > 0, lost + passed).alias("wrong"))
    best = placed.where("_good > 0 AND _bad > 0").groupBy("lang").agg(F.exp(F.min_by("at", F.struct("wrong", -F.col("_upto"), "bin"))).alias("threshold"))
    plain = rows.groupBy("lang").agg(F.max("poor").alias("_any"), F.percentile_approx("perplexity", QUANTILE, 10_000).alias("threshold")).where("NOT _any").select("lang", "threshold")
    return best.union(plain)


def judge(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, symbols, perplexity, threshold, keep for each row of docs(doc_id, text, lang), and with carry all of docs' columns.

    Texts are scored by the n-grams of ORDER characters that end at each of their characters (symbols), each language by a
    model of its own. Trusted texts are those that labels(doc_id, quality) gives quality 1; if the labels of an id differ,
    1 holds. All of them but a held-out fifth are counted. A language's threshold is the quantile of the held-out
    perplexities that labels choose (cuts_of), and a text is kept if its perplexity is not above. A language without
    held-out texts gets the threshold of all languages; a language without trusted texts has no model, and its texts are
    kept. Null and empty texts have no symbols, the mean perplexity of their language, and are kept; a null lang is a
    language; ids may be null or repeat; other columns stay with carry, those named like an added one are replaced; an
    empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("code", "trusted", "taught", "poor", "surprise", "symbols", "perplexity", "threshold", "keep", "_block")]
    with small_batches(docs.sparkSession):
        rows = flagged(docs.select(*own), labels)
        grams = settle(corpus_grams(rows))
        spelled = kneser_ney(grams)
        discard(grams)
        model = settle(hashed_model(spelled))
        discard(spelled)
        flags = ["trusted", "taught", "poor"]
        shown = [*own, *flags] if carry else ["doc_id", "lang", *flags]
        size = BLOCK // 2 if carry else BLOCK  # a task that returns texts also holds its block's as they are, not only compressed
        scored = settle(score(rows.select(*dict.fromkeys([*shown, "text", "code"])), model, shown, size))
        discard(model)
    base = scored
    held_out = F.col("trusted") & ~F.col("taught") & (F.col("symbols") > 0)
    mean = (F.sum(F.when(F.col("trusted"), F.col("surprise"))) / F.sum(F.when(F.col("trusted"), F.col("symbols")))).alias("mean")
    means = base.groupBy("lang").agg(mean).where("mean IS NOT NULL")
    overall = base.agg(mean).first()["mean"]
    surprise = lambda m: F.exp((F.col("surprise") + F.lit(PRIOR) * m) / (F.col("symbols") + PRIOR))
    if overall is None or math.isnan(overall):
        return scored.select(*(own if carry else ("doc_id", "lang")), "symbols", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    m = F.coalesce("mean", F.lit(overall))
    with_means = lambda d: d.join(means.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("perplexity", surprise(m)).withColumn("_known", F.col("mean").isNotNull()).drop("_lang", "mean")
    ppl = settle(with_means(base).where(held_out | (F.col("poor") & (F.col("symbols") > 0))).select("lang", "perplexity", "poor"))
    overall_cut = cuts_of(ppl.withColumn("lang", F.lit(""))).first()
    overall_cut = overall_cut["threshold"] if overall_cut else None
    cuts = cuts_of(ppl).withColumnRenamed("lang", "_lang")
    out = with_means(scored).join(cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("threshold", F.lit(overall_cut).cast("double"))
    keep = F.coalesce((F.col("symbols") == 0) | ~F.col("_known") | (F.col("perplexity") <= threshold), F.lit(True))
    return out.select(*(own if carry else ("doc_id", "lang")), "symbols", "perplexity", threshold.alias("threshold"), keep.alias("keep"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
