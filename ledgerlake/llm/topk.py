"""Operator 8: exact top-k inner products by the threshold algorithm of Fagin, Lotem and Naor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import settle
from ._vectors import matrix, usable, widened

#: A cell of the search holds at most about so many candidates and queries.
CANDIDATES, QUERIES = 8192, 2048
FIRST_DEPTH = 24
#: No bound: the least 64-bit number.
NONE = -(2**63)


class SortedLists:
    """Candidates of a block with a list per dimension, sorted by the component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable")

    def top(self, query_id: int, q: np.ndarray, k: int, least: float = NONE) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates other than the query's own, ties to the smaller id; none below least is needed.

        Sorted access goes down all lists at once, a stretch at a time, from their best end for the sign of the query's
        component. Each candidate met is scored at once (random access). No candidate that is not yet met can score more
        than the sum over the lists' last seen components; once the kth score is above that, the search ends.
        """
        n = len(self.ids)
        dims = np.flatnonzero(q)
        if not len(dims):
            mine = np.flatnonzero(self.ids != query_id)[:k]
            return mine, np.zeros(len(mine), q.dtype)
        up, down = dims[q[dims] < 0], dims[q[dims] > 0]
        met = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            stop = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[depth:stop, up]] = True
            fresh[self.order[n - stop : n - depth, down]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.x[new] @ q])
            own = self.ids[places] == query_id
            places, scores = places[~own], scores[~own]
            if len(scores) > k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
            good = scores >= least
            places, scores = places[good], scores[good]
            bound = (q[up] * self.x[self.order[stop - 1, up], up]).sum() + (q[down] * self.x[self.order[n - stop, down], down]).sum()
            if bound < least or (len(scores) >= k and scores.min() > bound):
                break
            depth, step = stop, step * 2
        best = np.lexsort((places, -scores))[:k]
        return places[best], scores[best]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidates_per_cell: int = CANDIDATES, queries_per_cell: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of vectors by inner product, itself apart.

    Both have (vec_id long, x array<long>); shorter arrays count as filled with zeros, null ids take no part, rows of one
    id are candidates each; other columns are ignored. Candidates and queries are dealt to the cells of a grid, so no task
    holds more than a cell. Every query first searches one block of candidates; its kth score there is the bound that
    lets the other cells stop early. A window merges what the cells give. Empty tables give no rows.
    """
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-n // candidates_per_cell)), max(1, -(-m // queries_per_cell))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    x = vectors.where("vec_id IS NOT NULL").select("vec_id", "x", block(rows).alias("row"))
    q = queries.where("vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), block(columns).alias("column"))
    home = F.pmod("column", F.lit(rows)).cast("int")

    def cell(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(xs) and len(qs):
            a, b = matrix(xs["x"], np.int64), matrix(qs["q"], np.int64)
            width = max(a.shape[1], b.shape[1])
            a, b = widened(a, width), widened(b, width)
            if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1) < 2**53:
                a, b = a.astype(np.float64), b.astype(np.float64)  # all sums are exact, and faster
            lists = SortedLists(xs["vec_id"].to_numpy(np.int64), a)
            for query_id, row, least in zip(qs["query_id"].to_numpy(np.int64), b, qs["least"], strict=True):
                places, scores = lists.top(int(query_id), row, k, least)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": lists.ids[places], "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    def search(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        return candidates.groupBy("row", "column").cogroup(asked.groupBy("row", "column")).applyInPandas(cell, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    met = x.join(F.broadcast(queries.sparkSession.range(columns).select(F.col("id").cast("int").alias("column"))), F.col("row") == home)  # a row for each block of queries
    found = settle(search(q.withColumn("row", home).withColumn("least", F.lit(NONE).cast("long")), met))
    if rows > 1:
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
        elsewhere = F.explode(F.filter(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r != home)).alias("row")
        asked = q.join(bound, "query_id", "left").select("query_id", "q", "column", F.coalesce("least", F.lit(NONE).cast("long")).alias("least"), elsewhere)
        others = x.select("vec_id", "x", "row", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")).where(F.col("row") != home)
        found = found.unionByName(search(asked, others))
    return first(found).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("x"))
    return exact_top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
