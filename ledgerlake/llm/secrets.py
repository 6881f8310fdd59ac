"""Operator 13: secrets in texts, told apart by how many owners have them; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import settle


def either_case(word: str) -> str:
    """A pattern for word's ASCII letters in either case; other signs stand for themselves."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The patterns of the base kinds, the group that holds the value and the least length of that value.
ASSIGN = f"""({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
#: Runs that may be a credential though nothing says so; they count if their value is of few owners and looks live, or is a value of a base span elsewhere.
BARE = ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A value that more owners have is a widely copied example.
MOST_OWNERS = 2
#: A live-looking value has a letter, a digit and so many different signs.
SIGNS = 10


def matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """array of (kind, i, gap, size, value): all matches from left to right, code points since the match before, code points, the group's text.

    A text without a match is read once. Positions follow from gap and size, which are summed row by row later on.
    """
    p = F.lit(pattern)
    whole, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size")))  # the last gap has no match
    both = F.zip_with(F.filter(sizes, lambda s: s["size"].isNotNull()), values, lambda s, v: F.struct(s.gap.alias("gap"), s["size"].alias("size"), v.alias("value")))
    placed = F.transform(both, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), s.gap.alias("gap"), s["size"].alias("size"), s.value.alias("value")))
    return F.when(F.regexp_like(text, p), placed).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>"))


def candidates(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """A row for each document (row, doc_id), settled, and its spans (row, owner, repository, kind, start, stop, digest, live), settled.

    A bare run that a base span overlaps is none. digest is SHA-256 of the value: no value leaves its document's task.
    """
    kinds = (*KINDS, BARE)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    arrays = [matches(F.col("text"), p, group, k) for k, (_, p, group, _) in enumerate(kinds)]
    live = lambda v: F.regexp_like(v, F.lit("[A-Za-z]")) & F.regexp_like(v, F.lit("[0-9]")) & (F.size(F.array_distinct(F.split(v, ""))) >= SIGNS)
    told = F.transform(F.flatten(F.array(*arrays)), lambda m: F.struct(
        m.kind.alias("kind"), m.i.alias("i"), m.gap.alias("gap"), m["size"].alias("size"),
        F.char_length(m.value).alias("length"), F.unhex(F.sha2(m.value.cast("binary"), 256)).alias("digest"), live(m.value).alias("live")))
    found = settle(rows.select("row", "doc_id", "owner", "repository", told.alias("found")))
    each = found.select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    stop = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*[F.lit(n) for *_, n in kinds]), F.col("kind") + 1)
    spans = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where(F.col("length") >= least)
    base = F.col("kind") < len(KINDS)
    ahead = F.max(F.when(base, F.col("stop"))).over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    clear = (F.coalesce(F.col("ahead"), F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))
    met = spans.withColumn("ahead", ahead).withColumn("after", after).where(base | clear)
    return found.select("row", "doc_id"), settle(met.select("row", "owner", "repository", "kind", "start", "stop", "digest", "live"))


def ownership(spans: DataFrame) -> DataFrame:
    """(digest, owners, repositories, known), settled: who has a value, and whether a base span has it.

    Equal (digest, owner, repository) become one in the task that has them, and counts are sums of those, so a value that
    stands in a third of all documents is no task of its own. A null owner is an owner, a null repository one of its.
    """
    there = spans.groupBy("digest", "owner", "repository").agg(F.max(F.col("kind") < len(KINDS)).alias("known"))
    by_owner = there.groupBy("digest", "owner").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    return settle(by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("known").alias("known")))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, most_owners: int = MOST_OWNERS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) for each document and its spans (row, kind, start, stop, owners, repositories, copied, live).

    docs(doc_id, text, ...): null text is empty, rows that agree are rows of their own, ids may be null. An owner is a
    source and a repository a source and language unless other columns are given. Base spans stay whatever their value;
    a value of more than most_owners owners is copied, of fewer live if it looks it. A bare run is a span if its value is
    live, or if it is of few owners and stands in a base span elsewhere. A document's spans are one result row, so they
    meet in one task. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows, spans = candidates(docs, owner, repository)
    copied = F.col("owners") > most_owners
    told = spans.drop("owner", "repository").join(ownership(spans), "digest").withColumn("copied", copied).withColumn("live", F.col("live") & ~copied)
    kept = told.where((F.col("kind") < len(KINDS)) | F.col("live") | (F.col("known") & ~copied))
    return rows, kept.drop("digest", "known")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.element_at(F.array(*[F.lit(k) for k, *_ in (*KINDS, BARE)]), F.col("kind") + 1)
    spans = spans.withColumn("said", F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string")))
    base = F.col("kind") < len(KINDS)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s.said), ",")
    at = F.struct("start", "kind", "said")
    number = lambda c: F.sum(c.cast("long"))
    by_row = spans.groupBy("row").agg(
        *[number(F.col("kind") == k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)], listed(F.when(base, at)).alias("base"), listed(at).alias("spans"),
        number(F.col("copied")).alias("n_copied"), number(F.col("live")).alias("n_live"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = rows.join(by_row, "row", "left")
    return out.select("doc_id", *[none(f"n_{kind}") for kind, *_ in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), none("n_copied"), none("n_live"))


def _matches_sql(kind: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT r, owner, repository, {kind} AS kind, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS vals, string_split_regex(text, '{p}') AS gaps FROM t"


OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source AS owner, concat_ws('/', source, lang) AS repository FROM documents),
m AS ({' UNION ALL '.join(_matches_sql(k, p, group) for k, (_, p, group, _) in enumerate((*KINDS, BARE)))}),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT r, owner, repository, kind, vals[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS a, length(found[i]) AS n FROM e),
f AS (SELECT r, owner, repository, kind, v, a::BIGINT AS a, (a + n)::BIGINT AS b, regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= {SIGNS} AS looks
    FROM s WHERE length(v) >= [6, 20, 24, 20][kind + 1]),
c AS (SELECT * FROM f WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND g.kind < 3 AND g.a < f.b AND f.a < g.b)),
o AS (SELECT v, count(*) AS owners, bool_or(known) AS known FROM (SELECT v, owner, bool_or(kind < 3) AS known FROM c GROUP BY v, owner) GROUP BY v),
k AS (SELECT c.*, owners > {MOST_OWNERS} AS copied, looks AND owners <= {MOST_OWNERS} AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS said FROM c JOIN o USING (v)
    WHERE kind < 3 OR owners <= {MOST_OWNERS} AND (looks OR known)),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind) AS spans, count(*) FILTER (copied) AS n_copied, count(*) FILTER (live) AS n_live FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live FROM t LEFT JOIN g USING (r)
"""
