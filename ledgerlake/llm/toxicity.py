"""Operator 4: cumulative-link ordinal regression of toxicity severity on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import shorter, tidy
from ._text import WORD_BYTES, flat, pieces, prefix, span_hash

#: The classifier is fitted on at most so many labelled rows, those of smallest hash.
FIT_ROWS = 8000
#: Features live in 2**BITS hashed places; a word gives itself and its first 4, 5 and 6 bytes.
BITS, PREFIXES = 20, (4, 5, 6)
GRADES = 4
#: A text is called toxic from this probability of a grade above 0 on.
TOXIC_FROM = 0.3


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and text number of every feature of every word."""
    is_word = WORD_BYTES[data]
    before, after = np.zeros_like(is_word), np.zeros_like(is_word)
    if len(data):
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        full = off[:-1] < off[1:]
        before[off[:-1][full]], after[off[1:][full] - 1] = False, False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    owner = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    sums, size = prefix(data), end - start
    place, text = [span_hash(sums, start, end)], [owner]
    for k in PREFIXES:
        long = size > k
        place.append(span_hash(sums, start[long], start[long] + k) + np.uint64(k))
        text.append(owner[long])
    return (np.concatenate(place) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(text)


@dataclass
class Ordinal:
    """Severity grades 0..len(thresholds): P(grade <= k) = 1 / (1 + exp(score - thresholds[k])), one score for all k."""

    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, a column each."""
        upto = 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))
        return np.diff(np.column_stack([np.zeros(len(score)), upto, np.ones(len(score))]), axis=1)

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


def counted(place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique(text.astype(np.int64) << BITS | place, return_counts=True)
    return key & ((1 << BITS) - 1), key >> BITS, n


def telling(row: np.ndarray, col: np.ndarray, bad: np.ndarray, z_least: float, most: int) -> np.ndarray:
    """Places of the features that are more frequent in bad texts than chance allows, the most telling ones, in order."""
    a = np.bincount(col[bad[row]], minlength=1 << BITS).astype(float)
    b = np.bincount(col[~bad[row]], minlength=1 << BITS).astype(float)
    n_bad, n_good = max(bad.sum(), 1), max((~bad).sum(), 1)
    p, q, all_ = a / n_bad, b / n_good, (a + b) / (n_bad + n_good)
    z = (p - q) / np.sqrt(np.maximum(all_ * (1 - all_), 1e-9) * (1 / n_bad + 1 / n_good))
    good = np.flatnonzero((z >= z_least) & (a >= 3) & (p > 4 * q))
    return np.sort(good[np.argsort(-z[good], kind="stable")[:most]])


def severity(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Labels say only whether a text is toxic; toxic texts get grades 1, 2, 3 by thirds of their number of telling features.

    hits counts features that other texts told: each half of the rows is graded by what the other half's labels single
    out, so no text takes part in the choice of the features that grade it.
    """
    grade = np.zeros(len(toxic), np.int64)
    bad = toxic > 0
    if bad.any():
        grade[bad] = 1 + np.searchsorted(np.quantile(hits[bad], [1 / 3, 2 / 3]), hits[bad])
    return grade


def fit(places: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray, rounds: int = 1000, decay: float = 2e-5, z_least: float = 5.0, most: int = 2048) -> Ordinal:
    """Fit by accelerated gradient steps on the features that are more frequent in toxic texts than chance allows."""
    n, bad = len(places), toxic > 0
    if not n or not bad.any() or bad.all():
        return Ordinal(np.zeros(0, np.int64), np.zeros(0, np.float32), np.array([30.0, 31.0, 32.0]) if not bad.all() or not n else np.array([-30.0, -29.0, -28.0]))
    row, col = np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate(places)
    good = telling(row, col, bad, z_least, most)
    half, n_hit = np.arange(n) % 2, np.zeros(n)
    for own in (0, 1):
        others = half[row] != own
        told = np.zeros(1 << BITS, bool)
        told[telling(row[others] // 2, col[others], bad[half != own], z_least, most)] = True
        mine = ~others & told[col]
        n_hit += np.bincount(row[mine], np.concatenate(counts)[mine], minlength=n)
    at = np.full(1 << BITS, -1)
    at[good] = np.arange(len(good))
    hit = at[col] >= 0
    grade = severity(toxic, n_hit)
    x = np.zeros((n, len(good)), np.float32)
    x[row[hit], at[col[hit]]] = 1 + np.log(np.concatenate(counts)[hit])
    w, t = np.zeros(len(good)), np.array([1.0, 2.0, 3.0])
    w_at, t_at, speed = w.copy(), t.copy(), 1.0
    v = np.ones(len(good)) / max(len(good), 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.T @ (x @ v) / n
        curve = float(np.linalg.norm(v)) or 1.0
        v = v / curve
    step = 1 / (0.5 * max(curve if len(good) else 1.0, 0.05) + decay)
    for _ in range(rounds):
        score = x @ w_at
        # logits of the two borders of each row's grade; outside borders are infinite
        border = np.concatenate([[-np.inf], t_at, [np.inf]])
        hi, lo = border[grade + 1] - score, border[grade] - score
        s_hi, s_lo = 1 / (1 + np.exp(-np.clip(hi, -60, 60))), 1 / (1 + np.exp(-np.clip(lo, -60, 60)))
        s_hi[np.isposinf(hi)], s_lo[np.isneginf(lo)] = 1.0, 0.0
        prob = np.maximum(s_hi - s_lo, 1e-12)
        d_hi, d_lo = s_hi * (1 - s_hi) / prob, s_lo * (1 - s_lo) / prob
        g_w = x.T @ ((d_hi - d_lo) / n).astype(np.float32) + decay * w_at
        g_t = np.array([(-d_hi[grade == k].sum() + d_lo[grade == k + 1].sum()) / n for k in range(GRADES - 1)])
        w_new, t_new = w_at - step * g_w, np.maximum.accumulate(t_at - min(step, 2.0) * g_t + np.arange(GRADES - 1) * 1e-6)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        w_at, t_at = w_new + (speed - 1) / faster * (w_new - w), np.maximum.accumulate(t_new + (speed - 1) / faster * (t_new - t))
        w, t, speed = w_new, t_new, faster
    return Ordinal(good, w.astype(np.float32), t)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal:
    """Fit on the labelled rows of smallest hash, rows of them at most; that bound is all that reaches the driver.

    If the labels of an id differ, toxic holds; null ids and null labels teach nothing; a null text has no features.
    Without toxic or without clean rows the model calls nothing, or everything, toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows)  # at most rows rows, so it can be broadcast
    # a row for each id: where ids repeat, the text that hashes lowest
    rows_in = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shorter(batches):
            data, off = flat(pc.utf8_lower(b.column("text")))
            ps, cs = [], []
            for lo, hi in pieces(off):
                place, text = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                col, row, n = counted(place, text)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    ps.append(col[edge[i] : edge[i + 1]].astype("<u4").tobytes())
                    cs.append(n[edge[i] : edge[i + 1]].astype("<u4").tobytes())
            yield pa.record_batch([pa.array(ps, pa.binary()), pa.array(cs, pa.binary()), b.column("toxic").cast(pa.int32()), b.column("doc_id").cast(pa.int64())], ["p", "c", "toxic", "doc_id"])

    got = rows_in.mapInArrow(tidy(gather), "p binary, c binary, toxic int, doc_id long").toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "p", "c", "toxic")), strict=True))
    return fit([np.frombuffer(p, "<u4").astype(np.int64) for _, p, _, _ in got], [np.frombuffer(c, "<u4") for _, _, c, _ in got], np.array([t for *_, t in got]))


def score_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs(doc_id, text) as doc_id, expected_severity (0 to 3), severity (the median grade) and toxic (P(grade > 0) >= TOXIC_FROM).

    Null and empty texts have no features and so the grade of an empty score; ids may be null or repeat; other columns
    are ignored; an empty table gives no rows. The model's table has 2**BITS places whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shorter(batches):
            table, own = shared.value
            data, off = flat(pc.utf8_lower(b.column("text")))
            score = np.zeros(b.num_rows)
            for lo, hi in pieces(off):
                place, text = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                hit = table[place] != 0
                col, row, n = counted(place[hit], text[hit])
                score[lo:hi] = np.bincount(row, table[col] * (1 + np.log(n)), minlength=hi - lo)
            p = own.grades(score)
            upto = np.cumsum(p, axis=1)
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(p @ np.arange(p.shape[1])), pa.array((upto < 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] <= 1 - TOXIC_FROM)], ["doc_id", "expected_severity", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(rate), "doc_id long, expected_severity double, severity int, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
