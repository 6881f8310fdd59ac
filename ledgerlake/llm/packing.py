"""Operator 9: packing documents into sequences by Martello-Toth reduction and best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import settle, small_batches, tidy
from ._tokens import tokenizer

TOKENIZER = "word_bpe_49k.json"
END = 1


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def cut(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut only beyond capacity."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = END.to_bytes(4, "little")
        for b in batches:
            texts, size, i = b["text"].fillna("").tolist(), 0, 0
            rows: list[tuple] = []
            for j, text in enumerate(texts):
                size += len(text)
                if size > 1 << 20 or j == len(texts) - 1:
                    for k, ids in enumerate(tokenizer(path).encode(texts[i : j + 1]), i):
                        ids += end
                        for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                            part = ids[at : at + 4 * capacity]
                            rows.append((k, p, at // 4, len(part) // 4, zlib.crc32(part)))
                    size, i = 0, j + 1
            out = pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy()[out["k"].to_numpy()] if len(out) else pd.Series([], dtype="Int64"))
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.drop(columns="k")

    text = F.make_valid_utf8("text").alias("text")  # bytes that are not UTF-8 become U+FFFD
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Solver:
    """Packs a histogram of lengths. A run (length, rank, n, sequence, per, offset) says: the n pieces of this length from
    this rank on go into sequences from sequence on, per of them in each, the first at offset."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts.astype(np.int64).copy(), capacity
        self.rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0

    def put(self, length: int, bins: int, per: int, sequence: int, offset: int) -> None:
        n = bins * per
        self.runs.append((length, int(self.rank[length]), n, sequence, per, offset))
        self.rank[length] += n
        self.counts[length] -= n

    def fix(self, *lengths: int) -> None:
        """Permanently give sequences to as many copies of this set as there are."""
        need = {x: lengths.count(x) for x in lengths}
        bins = int(min(self.counts[x] // k for x, k in need.items()))
        offset = 0
        for x, k in need.items():
            self.put(x, bins, k, self.sequences, offset)
            offset += x * k
        self.sequences += bins
        self.fixed += bins

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """A set with an item of length j that dominates every feasible set with such an item, if one of up to three is.

        A set dominates another if the other's items can be dealt to its items so that none gets more than its own
        length. To be safe, other sets may take any length that is left any number of times.
        """
        self.counts[j] -= 1
        left = np.flatnonzero(self.counts)
        self.counts[j] += 1
        room = self.capacity - j
        fits = left[left <= room]
        if not len(fits):
            return (j,)
        k, least = int(fits[-1]), int(fits[0])
        if k == room or 2 * least > room:
            return (j, k)
        if 3 * least > room:
            partner = np.searchsorted(fits, room - fits, "right") - 1
            sums = (fits + fits[partner])[partner >= 0]
            if not len(sums) or sums.max() <= k:
                return (j, k)
            below = fits[fits <= room - k]
            if len(below):
                b = int(below[-1])
                tall = fits[fits > b]
                partner = np.searchsorted(tall, room - tall, "right") - 1
                sums = (tall + tall[partner])[partner >= 0]
                if not len(sums) or sums.max() <= k:
                    need = {x: (j, k, b).count(x) for x in (j, k, b)}
                    if all(self.counts[x] >= n for x, n in need.items()):
                        return (j, k, b)
        return None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in np.flatnonzero(self.counts)[::-1]:
                while self.counts[j] and (found := self.dominating(int(j))):
                    self.fix(*found)
                    changed = True

    def best_fit(self) -> None:
        """Best fit in the order of decreasing length; sequences of one content are handled together."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, sequence: int, bins: int) -> None:
            if bins and room:
                if room not in groups:
                    insort(rooms, room)
                groups.setdefault(room, []).append((sequence, bins))

        for s in map(int, np.flatnonzero(self.counts)[::-1]):
            while n := int(self.counts[s]):
                at = bisect_left(rooms, s)
                if at == len(rooms):
                    room, sequence, bins = self.capacity, self.sequences, -(-n // (self.capacity // s))
                    self.sequences += bins
                else:
                    room = rooms[at]
                    sequence, bins = groups[room].pop()
                    if not groups[room]:
                        del groups[room], rooms[at]
                per = room // s
                whole = min(bins, n // per)
                if whole:
                    self.put(s, whole, per, sequence, self.capacity - room)
                    add(room - per * s, sequence, whole)
                    n -= whole * per
                if bins > whole and 0 < n < per:
                    self.put(s, 1, n, sequence + whole, self.capacity - room)
                    add(room - n * s, sequence + whole, 1)
                    whole += 1
                add(room, sequence + whole, bins - whole)

    def solve(self) -> pd.DataFrame:
        self.reduce()
        self.best_fit()
        return pd.DataFrame(self.runs, columns=["length", "rank", "n", "sequence", "per", "offset"]).sort_values(["length", "rank"])




def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None, rows_per_group: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the number of pieces of each length matters, and that is a table of at most capacity rows however large the
    input; the driver fixes the dominating sets of Martello and Toth on it and fits the rest. A piece finds its place by
    its rank among those of its length; ranks are counted in groups of about rows_per_group rows, so a length that a
    third of all pieces have is spread over many tasks. Null and empty texts are one end id; a null doc_id is kept; equal
    rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    path = path or word_bpe_path()
    with small_batches(docs.sparkSession):
        pieces = settle(cut(docs, capacity, path))
    total = pieces.count()
    groups = max(1, -(-total // rows_per_group))
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = pieces.groupBy("length", "_group").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # capacity rows at most
    by_length = np.zeros(capacity + 1, np.int64)
    by_length[histogram["length"].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    runs = Solver(by_length, capacity).solve()
    begin = F.sum("n").over(Window.partitionBy("length").orderBy("_group")) - F.col("n")
    begins = counts.select("length", "_group", begin.alias("_begin"))
    row = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_row", row).join(begins, ["length", "_group"]).withColumn("_rank", F.col("_begin") + F.col("_row"))
    length, first, sequence, per, offset = (runs[c].to_numpy(np.int64) for c in ("length", "rank", "sequence", "per", "offset"))
    widest = int(total) + 1
    place_of = length * widest + first

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, rank = b["length"].to_numpy(np.int64), b.pop("_rank").to_numpy(np.int64)
            run = np.searchsorted(place_of, size * widest + rank, "right") - 1
            within = rank - first[run]
            b["sequence_id"] = sequence[run] + within // per[run]
            b["offset"] = offset[run] + (within % per[run]) * size
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b

    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.select(*columns, "_rank").mapInPandas(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
