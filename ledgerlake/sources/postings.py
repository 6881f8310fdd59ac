"""An inverted index that is kept: a question reads the postings of its own terms, and of them the chunks that can still matter. (NUM-06, RAG-01)

A segment is what one batch added. Its documents are dealt to chunks of like length, and a row of its postings is a term in
a chunk, with the most often that it stands in a document there and the shortest such document: from these two follows a
bound of what the term can add to a score, whatever the mean length is by then. Postings lie in the order of their terms.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import tokens
from ..operators.lineage import few, setting, stored
from .sinks import _put, pointer, put_pointer

CHUNK = 256  # documents of a chunk, about
STEP = math.log(1.2)  # documents of a class differ in length by this ratio at most
OPENED = 4  # chunks of a question that are read before any can be left out
QUESTIONS = 256  # questions of a block, about: their weights are one matrix
CHUNKS = 64  # chunks of a group, about: a task has a group's postings and scores chunk by chunk
TEXTS = 1000  # texts that a Python worker gets at once
DIGITS = 9  # scores are rounded, so that equal documents tie whatever the order of their sums


def manifest(spark: SparkSession, folder: str) -> dict:
    """The segments of the index, by name, with their (documents, sized, words)."""
    version = pointer(spark, folder)
    if version is None:
        return {"segments": {}}
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifests/{version}.json").collect()))


def _read(spark: SparkSession, folder: str, what: str) -> DataFrame:
    segments = list(manifest(spark, folder)["segments"])
    if not segments:
        raise ValueError(f"no index in {folder}")
    return spark.read.parquet(*[f"{folder}/{s}/{what}" for s in segments])


_WORD = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256)])


def _array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number, and the different values."""
    found = _array(column).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(terms of each text, different terms of each text, these in a row, how often each is there) of lower texts; the terms are those of tokens()."""
    text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    _, offsets, raw = text.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw if raw is not None else b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    word = _WORD[data]
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    before[off[:-1][off[:-1] < off[1:]]] = False
    start = np.flatnonzero(word & ~before)
    n = np.diff(np.searchsorted(start, off))
    ends = np.concatenate([[0], np.cumsum(word)])  # letters up to each place
    bounds = np.concatenate([ends[start], ends[-1:]]).astype(np.int32)
    said = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[word]))])
    code, names = _codes(said)
    pair, times = np.unique(np.repeat(np.arange(len(n)), n) * max(len(names), 1) + code, return_counts=True)
    of = pair // max(len(names), 1)
    return n, np.bincount(of, minlength=len(n)), names.take(pa.array(pair % max(len(names), 1))), times


def _counted(docs: DataFrame) -> DataFrame:
    """(key, n, terms, tfs) of docs(key, text): each text's length, its different terms and how often it has each; n is null for a null text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, different, names, times = _terms_of(b.column("text"))
            off = pa.array(np.concatenate([[0], np.cumsum(different)]).astype(np.int32))
            size = pa.array(n.astype(np.int32), mask=b.column("text").is_null().to_numpy(zero_copy_only=False))
            yield pa.record_batch([b.column("key"), size, pa.ListArray.from_arrays(off, names), pa.ListArray.from_arrays(off, pa.array(times.astype(np.int64)))], ["key", "n", "terms", "tfs"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", F.lower("text").alias("text")).mapInArrow(count, f"key {kind}, n int, terms array<string>, tfs array<long>")


def _inverted(chunked: DataFrame) -> DataFrame:
    """(_chunk, term, df, most, least, entries) of chunked(_chunk, key, n, terms, tfs): the postings, chunk by chunk."""

    def invert(docs: pa.Table) -> pa.Table:
        terms, tfs = _array(docs.column("terms")), _array(docs.column("tfs"))
        doc = pc.list_parent_indices(terms).to_numpy()
        code, names = _codes(terms.flatten())
        order = np.argsort(code, kind="stable")
        begin = np.searchsorted(code[order], np.arange(len(names)))
        doc, tf = doc[order], tfs.flatten().to_numpy()[order]
        n = pc.fill_null(_array(docs.column("n")), 0).to_numpy()[doc]
        entries = pa.StructArray.from_arrays([_array(docs.column("key")).take(pa.array(doc)), pa.array(n, pa.int32()), pa.array(tf, pa.int64())], ["key", "n", "tf"])
        ends = np.concatenate([begin, [len(order)]])
        most, least = (np.maximum.reduceat(tf, begin), np.minimum.reduceat(n, begin)) if len(names) else (tf, n)
        chunk = pa.array([docs.column("_chunk")[0].as_py()] * len(names), pa.string())
        return pa.table({"_chunk": chunk, "term": names, "df": pa.array(np.diff(ends), pa.int64()), "most": pa.array(most, pa.int64()), "least": pa.array(least, pa.int32()), "entries": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)})

    kind = chunked.schema["key"].dataType.simpleString()
    return chunked.groupBy("_chunk").applyInArrow(invert, f"_chunk string, term string, df long, most long, least int, entries array<struct<key: {kind}, n: int, tf: long>>")


def _chunked(docs: DataFrame) -> DataFrame:
    """docs(key, n, ...) with _chunk: a class of lengths, and in it a place by the hash of the key."""
    length_class = F.floor(F.log(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("double")) / STEP).cast("int")
    rows = docs.withColumn("_class", length_class)
    sizes = rows.groupBy("_class").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))  # a row a class: under 200 for any length
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), F.col("_chunks"))
    return rows.join(F.broadcast(sizes), "_class").withColumn("_chunk", F.concat_ws(".", F.col("_class").cast("string"), place.cast("string"))).drop("_class", "_chunks")


def add(docs: DataFrame, folder: str, segment: str, key: str = "doc_id", text: str = "text") -> int:
    """Index a batch as a segment; how many documents it added.

    A segment that is there already changes nothing; one that broke off is in no manifest and is written again. Documents
    whose key an earlier segment has are left out, as are rows without a key; a key that stands twice in a batch is an
    error. A null text counts as a document and has no length; an empty one has length 0.
    """
    spark = docs.sparkSession
    about = manifest(spark, folder)
    if segment in about["segments"]:
        return 0
    new = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    if about["segments"]:
        new = new.join(_read(spark, folder, "lengths").select("key"), "key", "left_anti")
    place = f"{folder}/{segment}"
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS)):
        cut_up = stored(_counted(new))  # each text is read and cut up once
    lengths = cut_up.select("key", "n")
    counts = lengths.agg(F.count("*").alias("documents"), F.count("n").alias("sized"), F.sum("n").alias("words"), F.count_distinct("key").alias("keys")).first()
    if counts["keys"] != counts["documents"]:
        raise ValueError(f"{counts['documents'] - counts['keys']} rows repeat a key")
    lengths.write.mode("overwrite").parquet(f"{place}/lengths")
    # A chunk is a group of about CHUNK documents; a common term has a row for each chunk, so no group holds it whole.
    rows = _inverted(_chunked(cut_up).select("_chunk", "key", "n", "terms", "tfs"))
    rows = stored(rows.withColumn("chunk", F.concat(F.lit(f"{segment}/"), "_chunk")).drop("_chunk"))
    ordered = rows.repartitionByRange("term", "chunk").sortWithinPartitions("term", "chunk")
    ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{place}/postings")
    terms = rows.groupBy("term").agg(F.sum("df").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{place}/terms")
    about["segments"][segment] = [counts["documents"], counts["sized"], counts["words"] or 0]
    _put(spark, f"{folder}/manifests/{segment}.json", json.dumps(about, indent=1))
    put_pointer(spark, folder, segment)
    return counts["documents"]


class _Asked:
    """The weights of a block of questions as a matrix, questions by terms."""

    def __init__(self, asked: pa.Table):
        question, self.questions = _codes(asked.column("question"))
        term, self.terms = _codes(asked.column("term"))
        self.weights = np.zeros((len(self.questions), len(self.terms)))
        self.weights[question, term] = weight = asked.column("weight").to_numpy()
        self.says = None
        if (weight <= 0).any():  # else a sum tells whether it has a part
            self.says = np.zeros(self.weights.shape)
            self.says[question, term] = 1

    def places(self, term: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(_array(term), value_set=self.terms).to_numpy().astype(np.int64)

    def sums(self, term: np.ndarray, of: np.ndarray, n: int, part: np.ndarray, least: float = -np.inf) -> np.ndarray:
        """Questions by n: the sums of weight (least at least) times part of the terms; not a number where the question has none of them."""
        here, term = np.unique(term, return_inverse=True)
        parts = np.zeros((len(here), n))
        parts[term, of] = part
        out = np.maximum(self.weights[:, here], least) @ parts
        met = out != 0 if self.says is None else self.says[:, here] @ (parts != 0) > 0
        return np.where(met, out, np.nan)


def _part(tf: Column | np.ndarray, n: Column | np.ndarray, mean: float, k1: float, b: float) -> Column:
    """What a term of weight 1 adds: it grows with tf and falls with n."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


class Index:
    """An index as it is now, to be asked many questions at once."""

    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        self.spark, self.folder, self.k1, self.b, self.epsilon = spark, folder, k1, b, epsilon
        totals = list(manifest(spark, folder)["segments"].values())
        self.documents, sized, words = (sum(t[i] for t in totals) for i in range(3))
        self.mean = words / sized if words else 1.0

    def _idf(self, terms: DataFrame) -> DataFrame:
        """terms(term) with idf over all segments; a negative one is epsilon times the mean over all terms, which is taken only if there is one."""
        df = F.col("df").cast("double")
        idf = F.log(F.lit(float(self.documents)) - df + 0.5) - F.log(df + 0.5)
        every = _read(self.spark, self.folder, "terms")
        known = stored(every.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).select("term", idf.alias("idf")))
        if not known.where("idf < 0").limit(1).count():
            return known
        mean = every.groupBy("term").agg(F.sum("df").alias("df")).agg(F.avg(idf).alias("m")).first()["m"]
        return known.withColumn("idf", F.when(F.col("idf") < 0, F.lit(self.epsilon * mean)).otherwise(F.col("idf")))

    def _asked(self, questions: DataFrame, key: str, text: str) -> DataFrame:
        """(question, term, weight) of the questions' terms that the index knows."""
        said = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("question"), F.explode(tokens(F.col(text))).alias("term"))
        said = stored(said.groupBy("question", "term").agg(F.count("*").alias("times")))
        idf = few(self._idf(few(said.select("term").distinct())))
        asked = stored(said.join(idf, "term").select("question", "term", (F.col("idf") * F.col("times")).alias("weight")))
        blocks = max(1, -(-asked.select("question").distinct().count() // QUESTIONS))
        return few(asked.withColumn("block", F.pmod(F.xxhash64(F.col("question").cast("string")), F.lit(blocks)).cast("int")))

    def _met(self, asked: DataFrame, columns: list[str], wanted: DataFrame | None, work, schema: str) -> DataFrame:
        """What work(postings, asked) gives for each block of questions and group of chunks; of the wanted (block, chunk) only, if there are such."""
        groups = max(self.documents // (CHUNK * CHUNKS), 2 * self.spark.sparkContext.defaultParallelism)
        rows = _read(self.spark, self.folder, "postings").select("term", "chunk", *columns).join(few(asked.select("block", "term").distinct()), "term")
        rows = rows if wanted is None else rows.join(wanted, ["block", "chunk"], "left_semi")
        rows = rows.withColumn("_group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
        each = asked.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def run(postings: pa.Table, said: pa.Table) -> pa.Table:
            found = work(postings, _Asked(said)) if postings.num_rows and said.num_rows else ()
            return pa.concat_tables([arrow.empty_table(), *(pa.table(columns, arrow.names).cast(arrow) for columns in found)])

        return rows.groupBy("block", "_group").cogroup(each.groupBy("block", "_group")).applyInArrow(run, schema)

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """(question, chunk, bound): what no document of the chunk can exceed for the question."""
        mean, k1, b = self.mean, self.k1, self.b

        def work(heads: pa.Table, said: _Asked) -> Iterator[list[pa.Array]]:
            at, chunks = _codes(heads.column("chunk"))
            part = _part(heads.column("most").to_numpy(), heads.column("least").to_numpy(), mean, k1, b)
            found = said.sums(said.places(heads.column("term")), at, len(chunks), part, 0.0)
            q, c = np.nonzero(~np.isnan(found))
            yield [said.questions.take(pa.array(q)), chunks.take(pa.array(c)), pa.array(found[q, c])]

        return self._met(asked, ["most", "least"], None, work, f"question {asked.schema['question'].dataType.simpleString()}, chunk string, bound double")

    def _scores(self, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """(question, key, score) of the wanted (question, chunk), and of other questions of their blocks: the k best of each group of chunks at least, all of them whole scores."""
        mean, k1, b = self.mean, self.k1, self.b

        def work(postings: pa.Table, said: _Asked) -> Iterator[list[pa.Array]]:
            place, (at, chunks) = said.places(postings.column("term")), _codes(postings.column("chunk"))
            entries, best, found = _array(postings.column("entries")), np.full((len(said.questions), k), -np.inf), []
            order = np.argsort(at, kind="stable")
            for mine in np.split(order, np.searchsorted(at[order], np.arange(1, len(chunks)))):
                lists = entries.take(pa.array(mine))
                e = lists.flatten()
                doc, keys = _codes(e.field("key"))
                by_key = pc.array_sort_indices(keys).to_numpy().astype(np.int64)  # so that ties go to the smaller key
                rank = np.empty_like(by_key)
                rank[by_key] = np.arange(len(by_key))
                part = _part(e.field("tf").to_numpy(), e.field("n").to_numpy(), mean, k1, b)
                score = np.round(said.sums(np.repeat(place[mine], pc.list_value_length(lists).to_numpy()), rank[doc], len(keys), part), DIGITS)
                score[np.isnan(score)] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(score, top, 1)
                best = -np.sort(-np.concatenate([best, value], 1), axis=1)[:, :k]
                q, i = np.nonzero((value > -np.inf) & (value >= best[:, -1:]))
                found.append((q, keys.take(pa.array(by_key[top[q, i]])), value[q, i]))
            for q, keys, value in found:
                kept = value >= best[q, -1]
                yield [said.questions.take(pa.array(q[kept])), keys.filter(pa.array(kept)), pa.array(value[kept])]

        key = _read(self.spark, self.folder, "postings").select(F.get("entries", 0)["key"].alias("key")).schema["key"].dataType.simpleString()
        chunks = few(wanted.join(asked.select("question", "block").distinct(), "question").select("block", "chunk").distinct())
        return self._met(asked, ["entries"], chunks, work, f"question {asked.schema['question'].dataType.simpleString()}, key {key}, score double")

    def _plan(self, questions: DataFrame, k: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(asked, chunks opened, first scores, chunks left)."""
        asked = self._asked(questions, key, text)
        bounds = stored(self._bounds(asked))
        promising = Window.partitionBy("question").orderBy(F.desc("bound"), "chunk")
        ranked = bounds.withColumn("_at", F.row_number().over(promising))
        opened = few(ranked.where(F.col("_at") <= OPENED).select("question", "chunk"))
        first = stored(self._scores(asked, opened, k))
        kth = _best(first, k).groupBy("question").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k).select("question", "bar")
        rest = bounds.join(opened, ["question", "chunk"], "left_anti").join(few(kth), "question", "left")
        slack = 10.0 ** (1 - DIGITS)  # more than rounding and the order of sums can change
        return asked, opened, first, few(rest.where(F.col("bar").isNull() | (F.col("bound") + slack >= F.col("bar"))).select("question", "chunk"))

    def plan(self, questions: DataFrame, k: int, key: str = "question_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(asked, first scores, chunks left): the k best of the OPENED most promising chunks of a question are its bar; the chunks that cannot reach it are not read."""
        asked, _, first, left = self._plan(questions, k, key, text)
        return asked, first, left

    def search(self, questions: DataFrame, k: int, key: str = "question_id", text: str = "text") -> DataFrame:
        """(question, rank, key, score): the k best documents of each question that have a term of it, ties to the smaller key.

        The same scores as retrieve.bm25() gives question by question. Questions without an indexed term have no rows;
        questions of one id are one question of all their words.
        """
        asked, opened, _, left = self._plan(questions, k, key, text)
        return _best(self._scores(asked, opened.unionByName(left), k), k).select("question", "rank", "key", "score")


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
