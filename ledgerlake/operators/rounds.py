"""Order-dependent resolution by rounds of joins: every row is decided anew from all decisions of the round before, until none changes. (RES-01 to RES-03, RES-09)

What a row joins depends on earlier rows only. So if a round leaves every decision as it was, the first row's is right, hence
the second's, and so on: a fixed point is what reading the rows one by one gives. Rows whose decisions hang on each other in
a long chain are the only ones that need many rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import grown, sized, stored

#: Fixed values, in the order in which they count: identifiers that name a firm, and hints that name its place.
ID_KEYS = ("cik", "ein", "qid", "domain")
GEO_KEYS = ("state", "country", "city_state", "city")
#: A key's rows are thinned out in so many parts before they meet.
PARTS = 1024
_ALL, _NOWHERE, _AT = "*", "-", "="
_SORTED = tuple(sorted(ID_KEYS))


def prepared(rows: DataFrame) -> DataFrame:
    """rows(ordinal, key, identifiers, hints) as (ordinal, key, a column for each identifier and hint, keyset, geo): identifiers in lower case; a blank hint is there but names no place."""
    ids = [F.nullif(F.lower(F.try_element_at("identifiers", F.lit(k))), F.lit("")).alias(f"id_{k}") for k in _SORTED]
    hints = [F.when(F.map_contains_key("hints", k), F.struct(F.nullif(F.lower(F.trim(F.try_element_at("hints", F.lit(k)))), F.lit("")).alias("v"))).alias(f"at_{k}") for k in GEO_KEYS]
    out = rows.select("ordinal", "key", *ids, *hints)
    keyset = sum((F.when(F.col(f"id_{k}").isNotNull(), 1 << n).otherwise(0) for n, k in enumerate(_SORTED)), F.lit(0))
    return out.withColumn("keyset", keyset).withColumn("geo", F.coalesce(*[F.col(f"at_{k}").v for k in GEO_KEYS]))


def _thinned(rows: DataFrame, by: list[str], salt: str, keep) -> DataFrame:
    """The rows that keep(rows, window's columns) leaves, first within parts of each group, then within the group: a group with very many rows is thinned by many tasks."""
    part = rows.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(PARTS)))
    return keep(keep(part, [*by, "_part"]).drop("_part"), by)


def _firms(rows: DataFrame) -> DataFrame:
    """A row per firm that exists under the decisions: key, and for each identifier and hint the earliest value and since when. Sums, so a firm of very many rows is no task of its own."""
    since = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("ordinal").alias("since"), F.col(c).alias("v")))).alias(c)
    own = F.col("ordinal") == F.col("firm")
    return rows.groupBy("firm").agg(F.max(F.when(own, F.col("key"))).alias("key"), F.max(own).alias("_real"), *[since(f"id_{k}") for k in _SORTED], *[since(f"at_{k}") for k in GEO_KEYS]).where("_real").drop("_real")


def _holders(firms: DataFrame, values: DataFrame) -> DataFrame:
    """(k, v, firm, since, until): which firm has one of the values (k, v) at a time. Of those that have it, the one kept first counts."""
    pairs = F.array_compact(F.array(*[F.when(F.col(f"id_{k}").isNotNull(), F.struct(F.lit(n).alias("k"), F.col(f"id_{k}.v").alias("v"), F.col(f"id_{k}.since").alias("since"))) for n, k in enumerate(_SORTED)]))
    held = firms.select("firm", F.explode(pairs).alias("p")).select("firm", "p.*").join(values, ["k", "v"], "left_semi")

    def first_kept(rows: DataFrame, by: list[str]) -> DataFrame:
        before = F.min("firm").over(Window.partitionBy(*by).orderBy("since").rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_b", before).where("_b IS NULL OR firm < _b").drop("_b")

    left = _thinned(held, ["k", "v"], "firm", first_kept)
    return left.withColumn("until", F.lead("since").over(Window.partitionBy("k", "v").orderBy("since")))


def _reigns(firms: DataFrame, keysets: list[int]) -> DataFrame:
    """(key, place, asked, firm, since, until): which firm a row of a name, a place and a set of identifiers may join at a time.

    A row that no identifier matches shares no value with any firm, so an identifier contradicts wherever both have one:
    only firms without any of the row's identifiers come into question. A firm loses that state once, when it gets one of
    them; its place may change as hints arrive. Firms that an earlier one outlasts are left out.
    """
    at = [F.col(f"at_{k}") for k in GEO_KEYS]
    times = F.array_sort(F.array_distinct(F.array_compact(F.array(F.col("firm"), *[c.since for c in at]))))
    place = lambda t: F.coalesce(*[F.when(c.since <= t, c.v.v) for c in at])
    named = lambda t: F.coalesce(F.concat(F.lit(_AT), place(t)), F.lit(_NOWHERE))
    stays = F.transform("_times", lambda t: F.struct(named(t).alias("place"), t.alias("since")))
    moves = F.filter(stays, lambda s, i: (i == 0) | (s.place != F.get(stays, i - 1).place))
    spans = F.transform("_moves", lambda s, i: F.struct(s.place.alias("place"), s.since.alias("since"), F.get("_moves", i + 1).since.alias("until")))
    whole = F.array(F.struct(F.lit(_ALL).alias("place"), F.col("firm").alias("since"), F.lit(None).cast("long").alias("until")))
    ids = [F.col(f"id_{k}").since for k in _SORTED]
    timeline = firms.where("key <> ''").withColumn("_times", times).withColumn("_moves", moves)
    each = timeline.select("firm", "key", F.array(*ids).alias("_ids"), F.explode(F.concat(whole, spans)).alias("s")).select("firm", "key", "_ids", "s.*")
    asked = each.withColumn("asked", F.explode(F.array(*[F.lit(k) for k in keysets])))
    leaves = F.array_min(F.array(*[F.when(F.col("asked").bitwiseAND(1 << n) != 0, F.get("_ids", F.lit(n))) for n in range(len(ids))]))
    alive = asked.withColumn("_leaves", leaves).where("_leaves IS NULL OR since < _leaves").withColumn("until", F.least("until", "_leaves")).drop("_leaves", "_ids")
    end = F.coalesce(F.col("until"), F.lit((1 << 63) - 1))

    def not_outlasted(rows: DataFrame, by: list[str]) -> DataFrame:
        earlier = F.max(F.when(F.col("_born"), end)).over(Window.partitionBy(*by).orderBy("firm").rangeBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_m", earlier).where((F.col("_m").isNull()) | (end > F.col("_m"))).withColumn("since", F.greatest("since", "_m")).drop("_m")

    return _thinned(alive.withColumn("_born", F.col("since") == F.col("firm")), ["key", "place", "asked"], "firm", not_outlasted).drop("_born")


def _pairs(rows: DataFrame) -> DataFrame:
    """(ordinal, k, v) for each identifier of each row."""
    pairs = F.array_compact(F.array(*[F.when(F.col(f"id_{k}").isNotNull(), F.struct(F.lit(n).alias("k"), F.col(f"id_{k}").alias("v"))) for n, k in enumerate(_SORTED)]))
    return rows.where("keyset > 0").select("ordinal", F.explode(pairs).alias("p")).select("ordinal", "p.*")


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with a first guess of firm and with key only where others have it too, the identifiers (ordinal, k, v) that others have too, and these by value.

    The guess is the first row with one of a row's identifiers, else with its name and place. It only saves rounds.
    """
    pairs = _pairs(rows)
    values = sized(stored(pairs.groupBy("k", "v").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")))
    asked = stored(pairs.join(values, ["k", "v"]))
    by_id = asked.groupBy("ordinal").agg(F.min("first").alias("a"))
    place = F.coalesce("geo", F.lit("")).alias("g")
    names = rows.where("key <> ''").groupBy("key", place).agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
    often = sized(stored(names.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").drop("n")))
    firsts = sized(stored(names.join(often, "key", "left_semi").where("n > 1").select(F.col("key").alias("_k"), F.col("g").alias("_g"), "first")))
    found = rows.join(grown(by_id), "ordinal", "left").join(often.select(F.col("key").alias("_key")), F.col("key") == F.col("_key"), "left").join(firsts, (F.col("key") == F.col("_k")) & (place == F.col("_g")), "left")
    first = F.coalesce(F.when(F.col("a") < F.col("ordinal"), F.col("a")), F.col("first"), F.col("ordinal"))
    out = found.select(*[F.coalesce(F.col("_key"), F.lit("")).alias("key") if c == "key" else c for c in rows.columns], first.alias("firm"), F.lit("").alias("basis"))
    return stored(out), asked.drop("first"), values.drop("first")


def _round(rows: DataFrame, asked: DataFrame, values: DataFrame, keysets: list[int]) -> DataFrame:
    """rows with firm and basis decided anew; was is the firm before."""
    firms = stored(_firms(rows))
    now = (F.col("since") < F.col("ordinal")) & (F.col("until").isNull() | (F.col("ordinal") <= F.col("until")))
    by_id = asked.join(sized(stored(_holders(firms, values).withColumnRenamed("firm", "found"))), ["k", "v"]).where(now).groupBy("ordinal").agg(F.min(F.struct("found", "k")).alias("id"))
    known = stored(rows.join(grown(by_id), "ordinal", "left"))
    places = F.when(F.col("geo").isNull(), F.array(F.lit(_ALL))).otherwise(F.array(F.concat(F.lit(_AT), "geo"), F.lit(_NOWHERE)))
    open_ = known.where("id IS NULL AND key <> ''").select("ordinal", "key", F.col("keyset").alias("asked"), F.explode(places).alias("place"))
    by_name = open_.join(sized(stored(_reigns(firms, keysets).withColumnRenamed("firm", "found"))), ["key", "place", "asked"]).where(now).groupBy("ordinal").agg(F.min("found").alias("same"))
    basis = F.when(F.col("id").isNotNull(), F.concat(F.lit("identifier:"), F.element_at(F.array(*[F.lit(k) for k in _SORTED]), F.col("id.k") + 1))).when(F.col("same").isNotNull(), "name+geo").otherwise("")
    out = known.join(grown(by_name), "ordinal", "left")
    return out.withColumn("was", F.col("firm")).withColumn("firm", F.coalesce(F.col("id.found"), F.col("same"), F.col("ordinal"))).withColumn("basis", basis).drop("id", "same")


def decided(rows: DataFrame, most_rounds: int = 12) -> tuple[DataFrame, bool]:
    """prepared() rows with firm (the ordinal of the row that is kept for it) and basis, and whether all are settled.

    rows need different ordinals. was <> firm marks the rows that the last round still changed. Each round takes the firms
    that the decisions make, with what they hold since when, and asks for each row which firm held one of its identifiers,
    or else was of its name, place and without its identifiers, when the row came. Names and identifiers that one row
    alone has decide nothing and are left out.
    """
    rows = stored(rows)
    keysets = sorted(r[0] for r in rows.select("keyset").distinct().collect())  # 2 ** len(ID_KEYS) at most
    now, asked, values = _shared(rows)
    for _ in range(most_rounds):
        now = stored(_round(now.drop("was"), asked, values, keysets))
        if not now.where("was <> firm").limit(1).count():
            return now, True
    return now, False


def geo_of(hints: str | Column = "hints") -> Column:
    """The first place that the hints name. (ARR-09)"""
    return F.coalesce(*[F.nullif(F.lower(F.trim(F.try_element_at(hints, F.lit(k)))), F.lit("")) for k in GEO_KEYS])
