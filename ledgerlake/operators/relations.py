"""Joins, windows, set operations and ordered picks (JOIN, WIN, SET, SRT) over any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Letters of the pieces by which names that contain one another are brought together.
GRAM = 4


def first_wins(rows: DataFrame, keys: list[str] | list[Column], order: list) -> DataFrame:
    """One row for each key, the first in order. (WIN-06, AGG-21, AGG-22)"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_per_key(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """As first_wins() for the highest of by, with partial aggregation instead of a sort. (AGG-21, RES-07)"""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])).alias("_b"))
    return best.select(*keys, "_b.*")


def with_facts(rows: DataFrame, facts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins to fact tables by their own keys; each fact table has a row a key. (JOIN-01, JOIN-02, JOIN-04)"""
    return reduce(lambda d, f: d.join(f[0], f[1], "left"), facts, rows)


def precedence(name: str, *sources: Column) -> Column:
    """The first source that is neither null nor empty. (CLS-07, ARR-11)"""
    return F.coalesce(*[F.nullif(s.cast("string"), F.lit("")) for s in sources]).alias(name)


def either_key_semi(rows: DataFrame, there: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that are there by the first key, or by the second where the first is null: two semi joins. (JOIN-05)"""
    by_first = rows.join(there.select(first).distinct(), first, "left_semi")
    by_second = rows.where(F.col(first).isNull()).join(there.where(F.col(first).isNull()).select(second).distinct(), second, "left_semi")
    return by_first.unionByName(by_second.select(*by_first.columns))


def net_new(rows: DataFrame, existing: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Rows that share none of the keys with what exists, nor with an earlier row of their own. (JOIN-06, JOIN-07, MNT-06, MNT-07)

    Each key is an anti join of its own; a null key matches nothing.
    """
    for k in keys:
        rows = rows.join(existing.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    if order is None:
        return rows
    for k in keys:
        w = Window.partitionBy(k).orderBy(order)
        rows = rows.withColumn("_rn", F.when(F.col(k).isNull(), 1).otherwise(F.row_number().over(w))).where("_rn = 1").drop("_rn")
    return rows


def contains_either_way(rows: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose name equals, contains or is in one of names, a table of shapes, say. (JOIN-17)

    Names that contain one another share their shorter one's first letters: GRAM of them, or all if it has fewer. So
    each row meets only names that have one of its pieces of that length first, or whose pieces have its first. An empty
    or null name is in none.
    """
    x, y = F.lower(F.col(a)), F.lower(F.col(b))
    piece = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    left, right = rows.withColumn("_row", F.monotonically_increasing_id()), names.withColumn("_name", F.monotonically_increasing_id())
    left, right = cut(left), cut(right)
    met = None
    for n in range(1, GRAM + 1):  # the shorter of the two has n letters, or GRAM at least
        fits = lambda c: (F.length(c) == n) if n < GRAM else (F.length(c) >= n)  # noqa: E731, B023
        heads = lambda t, c, k: t.where(fits(c) & (F.length(c) > 0)).select(k, F.substring(c, 1, n).alias("p"))  # noqa: E731, B023
        parts = lambda t, c, k: t.select(k, F.explode(piece(c, n)).alias("p"))  # noqa: E731, B023
        one = heads(right, y, "_name").join(parts(left, x, "_row"), "p").select("_row", "_name").union(heads(left, x, "_row").join(parts(right, y, "_name"), "p").select("_row", "_name"))
        met = one if met is None else met.union(one)
    pairs = met.distinct().join(left, "_row").join(right, "_name").where(F.contains(x, y) | F.contains(y, x))
    return left.join(pairs.select("_row", *names.columns), "_row", "left").drop("_row")


#: Up to so many rows one window ranks a whole table; larger ones are sorted by range and numbered from the partitions' sizes.
ONE_WINDOW = 200_000


def numbered(rows: DataFrame, order: list, name: str, most: int | None = None) -> DataFrame:
    """rows with their place from 0 in the order. No task sorts more than its range of a large table. (WIN-01)"""
    if rows.limit((ONE_WINDOW if most is None else most) + 1).count() <= (ONE_WINDOW if most is None else most):
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    placed = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    met = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return met.withColumn(name, (F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id", "_part", "_begin")


def ranked(rows: DataFrame, score: str, ordinal: str, where: Column | None = None, name: str = "rank") -> DataFrame:
    """Rank from 0 by falling score, ties in order, among the rows with signal. (WIN-01, SRT-02)"""
    return numbered(rows if where is None else rows.where(where), [F.desc(score), ordinal], name)


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows in order. (SRT-01, SRT-07, SRT-08)"""
    return rows.orderBy(*order).limit(k)


def top_by_group(rows: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first k rows of each group in order; each task keeps k of a group before rows move. (WIN-06)"""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def added_since_last(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each key and time the values that the time before had not, sorted. (WIN-02, SET-01)"""
    sets = rows.groupBy(key, at).agg(F.collect_set(value).alias("now"))
    before = F.lag("now").over(Window.partitionBy(key).orderBy(at))
    return sets.withColumn("before", before).where("before IS NOT NULL").select(key, at, F.array_sort(F.array_except("now", "before")).alias("added"))


def suffixed_keys(rows: DataFrame, base: str, ordinal: str, name: str = "unique_key") -> DataFrame:
    """base for its first row, base#2, base#3 for the next. (WIN-05)"""
    n = F.row_number().over(Window.partitionBy(base).orderBy(ordinal))
    return rows.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), n.cast("string"))))


def balanced(rows: DataFrame, source: str, quality: list, ordinal: str, target: int, max_share: float = 0.4) -> DataFrame:
    """target rows, dealt round-robin over sources by quality, with no more than a share each unless rows run short. (WIN-03, WIN-04)

    Adds phase: 1 for rows under the cap, 2 for rows that fill up.
    """
    cap = max(1, int(max_share * target))
    seen = rows.groupBy(source).agg(F.min(ordinal).alias("_seen"))
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*quality, ordinal))
    first = rows.withColumn("_turn", turn).where(F.col("_turn") <= cap)  # each task keeps cap rows of a source before rows move
    under = cut(first.join(seen, source).orderBy("_turn", "_seen").limit(target).withColumn("phase", F.lit(1)))
    taken = under.select(F.col(ordinal).alias("_o"))
    rest = rows.join(F.broadcast(taken), F.col(ordinal) == F.col("_o"), "left_anti").join(seen, source)  # taken has target rows at most
    fill = rest.orderBy(*quality, "_seen", ordinal).limit(target - under.count()).withColumn("phase", F.lit(2))
    return under.drop("_turn", "_seen").unionByName(fill.drop("_seen"))


def delta(rows: DataFrame, at: str, value: str, by: str | None = None) -> DataFrame:
    """Change of a value since the row before. (WIN-07)"""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(at)
    return rows.withColumn("change", F.col(value) - F.lag(value).over(w))


def union_distinct(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, each once. (SET-03, SET-06)"""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def append_batch(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new, columns that one lacks null. (SET-07)"""
    return old.unionByName(new, allowMissingColumns=True)


def shared_identifier(a: Column, b: Column) -> Column:
    """The smallest identifier that two arrays share. (SET-02)"""
    return F.array_min(F.array_intersect(a, b))


def hits_first(hits: DataFrame, everything: DataFrame, key: str, ordinal: str) -> DataFrame:
    """hits in their order, then all other rows in theirs, each key once. (SET-08)"""
    both = hits.withColumn("_pass", F.lit(0)).unionByName(everything.withColumn("_pass", F.lit(1)))
    return first_wins(both, [key], ["_pass", ordinal]).orderBy("_pass", ordinal).drop("_pass")


def sorted_directory(rows: DataFrame, column: str, kind: str = "text", descending: bool = False, ordinal: str = "ordinal") -> DataFrame:
    """Directory order: sizes by number, confidence by rank, else by text; missing first. (SRT-07)"""
    from ..functions.measures import sortable_aum

    c = F.col(column)
    key = sortable_aum(c) if kind == "size" else F.coalesce(F.when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1), F.lit(0)) if kind == "confidence" else F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return rows.orderBy(key.desc() if descending else key.asc(), ordinal)
