"""Queries over the shared tables: each exercises operators of this package, and each has its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as X
from ..operators import classify as C
from ..operators import compute as A
from ..operators import filters as P
from ..operators import relations as R
from ..operators import retrieve as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-01-01"


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.removesuffix("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_with_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(labels, "doc_id", "left")


LABELLED = "WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), dl AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN l USING (doc_id)) "
NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[.,]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\bthe\b', ' ', 'g'), '\b(llc|lp|llp|inc|incorporated|ltd|limited|co|corp|corporation|company|plc|pllc|gmbh|ag|sa|nv|bv|spa|pte|pty)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("""SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS value, count(*)::BIGINT AS total_records, count(*)::BIGINT AS searched,
count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS qualified, NULL::BIGINT AS carried_measure, count(*)::BIGINT AS included_in_calc FROM orders""")
def scoped_count(spark, d):
    """AGG-01 FLT-01"""
    return A.scoped_count(table(spark, d, "orders"), P.matches(o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None))


@query("""SELECT coalesce(nullif(c_mktsegment, ''), '(blank)') AS key, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def distribution_segment(spark, d):
    """AGG-03 SRT-03"""
    return A.distribution(table(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal") > 0, "c_custkey")


@query("""SELECT l_returnflag AS measure_type, sum(l_extendedprice::DECIMAL(38,2))::DOUBLE AS total, count(*)::BIGINT AS n_included FROM lineitem GROUP BY 1""")
def typed_total(spark, d):
    """AGG-02"""
    return A.totals_by_type(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT l_extendedprice, l_returnflag FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT (SELECT sum(l_extendedprice::DECIMAL(38,2))::DOUBLE FROM m WHERE l_returnflag = 'R') AS value, 'R' AS measure_type, (SELECT count(*) FROM orders)::BIGINT AS total_records,
(SELECT count(*) FROM orders)::BIGINT AS searched, (SELECT count(*) FROM o)::BIGINT AS qualified, (SELECT count(*) FROM m)::BIGINT AS carried_measure, (SELECT count(*) FROM m WHERE l_returnflag = 'R')::BIGINT AS included_in_calc""")
def scoped_typed_total(spark, d):
    """AGG-02 with its scope, FLT-01"""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("measure_type"))
    return A.typed_total(table(spark, d, "orders"), lines, P.matches(o_orderstatus="F"), "R", "o_orderkey", ("A", "N", "R"))


@query(LABELLED + """SELECT count(quality)::BIGINT AS with_route, count(*) FILTER (quality = 1)::BIGINT AS verified_route, count(*)::BIGINT AS total_records FROM dl""")
def route_coverage(spark, d):
    """AGG-04"""
    return A.route_coverage(documents_with_labels(spark, d), F.col("quality"), F.col("quality"), ("1",))


@query(f"""SELECT coalesce(date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')::VARCHAR, 'None') AS key, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def freshness_days(spark, d):
    """AGG-05 DAT-03"""
    days = M.days_since(F.col("o_orderdate").cast("date").cast("string"), F.lit(AS_OF).cast("date"))
    return A.freshness(table(spark, d, "orders").select(days.alias("days")), "days")


@query(LABELLED + """SELECT count(*)::BIGINT AS total, count(*) FILTER (quality IS NOT NULL)::BIGINT AS labelled, count(*) FILTER (coalesce(quality = 1, false))::BIGINT AS good,
count(*) FILTER (coalesce(lang <> '', false))::BIGINT AS with_lang, count(*) FILTER (coalesce(n_chars >= 1000, false))::BIGINT AS long FROM dl""")
def field_coverage(spark, d):
    """AGG-07 AGG-09 AGG-11"""
    return A.field_coverage(documents_with_labels(spark, d), {"labelled": F.col("quality").isNotNull(), "good": F.coalesce(F.col("quality") == 1, F.lit(False)), "with_lang": P.filled(F.col("lang")), "long": F.coalesce(F.col("n_chars") >= 1000, F.lit(False))})


@query(LABELLED + """, s AS (SELECT count(*) AS a, count(*) FILTER (length(text) > 0) AS b, count(*) FILTER (length(text) > 0 AND quality IS NOT NULL) AS c, count(*) FILTER (length(text) > 0 AND quality = 1) AS e,
count(*) FILTER (length(text) > 0 AND quality = 1 AND toxic = 0) AS f FROM dl)
SELECT 0 AS place, 'all' AS step, a::BIGINT AS n, round(100.0 * a / a::DOUBLE, 1)::DOUBLE AS pct FROM s UNION ALL SELECT 1, 'has text', b, round(100.0 * b / a::DOUBLE, 1)::DOUBLE FROM s UNION ALL SELECT 2, 'labelled', c, round(100.0 * c / a::DOUBLE, 1)::DOUBLE FROM s
UNION ALL SELECT 3, 'good', e, round(100.0 * e / a::DOUBLE, 1)::DOUBLE FROM s UNION ALL SELECT 4, 'not toxic', f, round(100.0 * f / a::DOUBLE, 1)::DOUBLE FROM s""")
def funnel(spark, d):
    """AGG-14 AGG-18 NUM-11"""
    return A.funnel(documents_with_labels(spark, d), [("all", F.lit(True)), ("has text", F.length("text") > 0), ("labelled", F.col("quality").isNotNull()), ("good", F.col("quality") == 1), ("not toxic", F.col("toxic") == 0)])


@query("""WITH x AS (SELECT l.toxic = 1 AS t, d.n_chars < 1500 AS p FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p)::BIGINT AS tp, count(*) FILTER (NOT t AND p)::BIGINT AS fp,
count(*) FILTER (NOT t AND NOT p)::BIGINT AS tn, count(*) FILTER (t AND NOT p)::BIGINT AS fn FROM x)
SELECT tp, fp, tn, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(fp / (fp + tn)::DOUBLE, 4) AS false_positive_rate, round(fn / (fn + tp)::DOUBLE, 4) AS false_negative_rate,
round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 4) AS accuracy FROM c""")
def goldset_metrics(spark, d):
    """AGG-13 JOIN-03"""
    met = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return A.confusion(met, F.col("toxic") == 1, F.col("n_chars") < 1500)


@query(f"""SELECT 'supplier' AS kind, s_suppkey AS id, {NORM_SQL.format('s_name')} AS key, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS squashed FROM supplier
UNION ALL SELECT 'part', p_partkey, {NORM_SQL.format('p_name')}, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') FROM part""")
def norm_names(spark, d):
    """TXT-01 TXT-03"""
    row = lambda t, kind, key, name: table(spark, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), X.norm_name(F.col(name)).alias("key"), X.alnum(F.col(name)).alias("squashed"))
    return row("supplier", "supplier", "s_suppkey", "s_name").unionAll(row("part", "part", "p_partkey", "p_name"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(*)::BIGINT AS n FROM t GROUP BY term""")
def tokens_tf(spark, d):
    """TXT-05"""
    return table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"""SELECT s_suppkey, 'fo_' || substr(sha256({NORM_SQL.format('s_name')}), 1, 10) AS entity_id, sha256(s_name) AS content_hash FROM supplier""")
def entity_ids(spark, d):
    """TXT-29 TXT-30"""
    return table(spark, d, "supplier").select("s_suppkey", X.entity_id(X.norm_name(F.col("s_name"))).alias("entity_id"), X.content_hash(F.col("s_name")).alias("content_hash"))


@query(r"""SELECT page_id, coalesce(regexp_extract(lower(trim(url)), 'https?://(?:www\.)?([^/?#]+)', 1), '') AS host, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/+$', '') AS site FROM pages""")
def url_parts(spark, d):
    """TXT-07 TXT-08"""
    return table(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.norm_website(F.col("url")).alias("site"))


@query(r"""SELECT doc_id, list_sort(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}')) AS emails, len(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}'))::INTEGER AS phones FROM documents
WHERE regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}') OR regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')""")
def extract_contacts(spark, d):
    """TXT-15 TXT-09"""
    shown = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
    rows = table(spark, d, "documents").where(F.col("text").rlike(X.EMAIL) | F.col("text").rlike(shown))
    return rows.select("doc_id", F.array_sort(F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0))).alias("emails"), F.regexp_count("text", F.lit(shown)).alias("phones"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::INTEGER AS sentences,
list_max(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s))))::INTEGER AS longest FROM documents""")
def sentence_counts(spark, d):
    """TXT-17"""
    pieces = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(pieces).alias("sentences"), F.array_max(F.transform(pieces, F.length)).alias("longest"))


@query("""SELECT event_type, count(*)::BIGINT AS n, count(json_extract_string(props, '$.k'))::BIGINT AS with_k, round(sum(value::DECIMAL(38,6))::DOUBLE, 4) AS total FROM events GROUP BY event_type""")
def json_props(spark, d):
    """JSN-01 JSN-05"""
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k string"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("with_k"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4).alias("total"))


@query("""SELECT role, count(*)::BIGINT AS turns, count(DISTINCT conv_id)::BIGINT AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role""")
def explode_turns(spark, d):
    """ARR-06 ARR-07: nest the turns of conversations and explode them again"""
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    flat = nested.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    return flat.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


HASHED = r"SELECT *, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM "


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256))


@query(f"""WITH h AS ({HASHED} documents) SELECT h, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM h GROUP BY h""")
def dedupe_exact(spark, d):
    """WIN-06 RES-06 SNK-03 SNK-07"""
    return hashed(table(spark, d, "documents").select("doc_id", "text")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(LABELLED + f""", h AS ({HASHED} dl) SELECT h, arg_max(doc_id, row(coalesce(quality, -1), n_chars, -doc_id)) AS doc_id FROM h GROUP BY h""")
def dedupe_survivor(spark, d):
    """RES-07 RES-08: the best of each group by quality, length and order"""
    rows = hashed(documents_with_labels(spark, d)).select("h", "doc_id", "quality", "n_chars")
    return R.best_per_key(rows, ["h"], [F.coalesce("quality", F.lit(-1)), F.col("n_chars"), -F.col("doc_id")]).select("h", "doc_id")


@query(r"""WITH k AS (SELECT page_id, regexp_extract(lower(trim(url)), 'https?://(?:www\.)?([^/?#]+)', 1) AS host FROM pages), n AS (SELECT page_id, min(page_id) OVER (PARTITION BY host) AS root FROM k)
SELECT page_id AS id, root FROM n WHERE root IN (SELECT root FROM n GROUP BY root HAVING count(*) > 1)""")
def identifier_merge(spark, d):
    """RES-01 RES-02 SET-02: records that share an identifier are one entity"""
    from ..operators.resolve import entities

    rows = table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), F.array(F.concat(F.lit("domain:"), X.host(F.col("url")))).alias("ids"))
    return entities(rows)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] AS block FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INTEGER AS distance FROM n a JOIN n b ON a.block = b.block AND a.name < b.name WHERE levenshtein(a.name, b.name) <= 6""")
def fuzzy_pairs(spark, d):
    """JOIN-15 TXT-23: pairs within a block"""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("block", F.get(F.split("name", " "), F.lit(0)))
    pairs = n.alias("x").join(n.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.name") < F.col("y.name")))
    return pairs.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.levenshtein("x.name", "y.name").alias("distance")).where("distance <= 6")


@query("""WITH r AS (SELECT s_suppkey, 'nation:' || s_nationkey AS base, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) SELECT s_suppkey, CASE WHEN n = 1 THEN base ELSE base || '#' || n END AS unique_key FROM r""")
def key_suffix(spark, d):
    """WIN-05"""
    rows = table(spark, d, "supplier").withColumn("base", F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")))
    return R.suffixed_keys(rows, "base", "s_suppkey").select("s_suppkey", "unique_key")


@query("""WITH o AS (SELECT o_custkey, max(o_totalprice) AS most, count(*)::BIGINT AS orders FROM orders GROUP BY 1) SELECT c_custkey, n_name, orders, coalesce(nullif(most::VARCHAR, ''), nullif(c_acctbal::VARCHAR, '')) IS NOT NULL AS has_figure, coalesce(orders, 0)::BIGINT AS n_orders
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey""")
def left_join_facts(spark, d):
    """JOIN-01 JOIN-02 CLS-07 ARR-11"""
    facts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"), F.count("*").alias("orders"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = R.with_facts(table(spark, d, "customer"), [(nations, "c_nationkey"), (facts, "c_custkey")])
    return rows.select("c_custkey", "n_name", "orders", R.precedence("f", F.col("most"), F.col("c_acctbal")).isNotNull().alias("has_figure"), F.coalesce("orders", F.lit(0)).alias("n_orders"))


@query("""SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti(spark, d):
    """JOIN-06 JOIN-08 JOIN-13 JOIN-18"""
    customers, keys = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(keys, "c_custkey", "left_semi").withColumn("kind", F.lit("with")).unionAll(R.net_new(customers, keys, "c_custkey").withColumn("kind", F.lit("without")))


@query("""WITH old AS (SELECT * FROM part WHERE p_size >= 50) SELECT p_partkey FROM part WHERE p_size < 50 AND p_name NOT IN (SELECT p_name FROM old) AND p_retailprice NOT IN (SELECT p_retailprice FROM old)""")
def disjunctive_anti(spark, d):
    """JOIN-07 SRC-25 MNT-07: smaller parts that share neither name nor price with the largest ones"""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    return R.net_new(parts.where("p_size < 50"), parts.where("p_size >= 50"), "p_name", "p_retailprice").select("p_partkey")


@query("""SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey""")
def latest_per_key(spark, d):
    """AGG-21 AGG-22 WIN-06"""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.best_per_key(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("latest"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS now FROM events GROUP BY 1, 2), b AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY day) AS before FROM s)
SELECT user_id, day, list_filter(now, lambda x: NOT list_contains(before, x)) AS added FROM b WHERE before IS NOT NULL""")
def new_vs_previous(spark, d):
    """WIN-02 SET-01"""
    return R.added_since_last(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day", "event_type")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 100000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P')
SELECT c.o_orderkey, list_filter([CASE WHEN p.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p.o_totalprice IS DISTINCT FROM c.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL) AS fields
FROM c JOIN orders p USING (o_orderkey) WHERE p.o_orderstatus IS DISTINCT FROM c.o_orderstatus OR p.o_totalprice IS DISTINCT FROM c.o_totalprice""")
def snapshot_diff(spark, d):
    """CYC-01 CYC-02 JOIN-10: a later state of the orders, in which pending ones are gone and some changed"""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = old.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return C.trust_changes(old, new, ("o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey").select("o_orderkey", F.transform("changed", lambda c: c.field).alias("fields"))


@query("""WITH w AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS seen FROM documents) SELECT doc_id, source FROM w WHERE turn <= 20 ORDER BY turn, seen LIMIT 50""")
def balanced_select(spark, d):
    """WIN-03 WIN-04: 50 documents, round-robin by source under a cap of 40 %"""
    return R.balanced(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars")], "doc_id", 50).select("doc_id", "source")


RULES = ((r"(?i)brass|copper", "red metal"), (r"(?i)steel|tin|nickel", "white metal"), (r"(?i)economy", "plain"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass|copper') THEN 'red metal' WHEN regexp_matches(p_type, '(?i)steel|tin|nickel') THEN 'white metal' WHEN regexp_matches(p_type, '(?i)economy') THEN 'plain' ELSE 'other' END AS class FROM part""")
def classify_rules(spark, d):
    """CLS-01 CLS-02: the first of ordered patterns"""
    return table(spark, d, "part").select("p_partkey", C.first_match(F.col("p_type"), RULES, F.lit("other")).alias("class"))


@query("""WITH e AS (SELECT s_suppkey, s_nationkey % 3 = 0 AS sm, n_regionkey = 1 AS gm, s_suppkey % 4 <> 0 AS ev, CASE s_suppkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS conf, s_suppkey % 3 AS ns, s_suppkey % 2 AS sig, s_suppkey % 5 <> 0 AS route, s_suppkey % 800 AS days, s_suppkey % 6 <> 0 AS th
FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, round(greatest(0.0, least(1.0, (CASE WHEN sm THEN 0.35 ELSE 0 END)::DOUBLE + (CASE WHEN gm THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN ev THEN 0.15 ELSE 0 END)::DOUBLE + (CASE conf WHEN 'High' THEN 0.2 WHEN 'Medium' THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN ns >= 2 THEN 0.1 WHEN ns = 1 THEN 0.03 ELSE 0 END)::DOUBLE
+ (CASE WHEN sig > 0 THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN route THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN days > 400 THEN -0.1 ELSE 0 END)::DOUBLE)), 3)::DOUBLE AS fit_score,
CASE WHEN NOT ev THEN 'insufficient' WHEN days > 400 THEN 'stale' WHEN ns = 0 AND NOT sm THEN 'insufficient' WHEN ns <= 1 OR NOT sm OR NOT th THEN 'thin' ELSE 'sufficient' END AS uncertainty FROM e""")
def fit_score(spark, d):
    """NUM-08 CLS-04"""
    k = F.col("s_suppkey")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = table(spark, d, "supplier").join(nations, "s_nationkey").select(
        "s_suppkey", (F.col("s_nationkey") % 3 == 0).alias("sector_match"), (F.col("n_regionkey") == 1).alias("geography_match"), F.lit("Undetermined").alias("fo_type"), F.when(k % 4 != 0, "yes").alias("fo_type_evidence"),
        F.when(k % 3 == 0, "High").when(k % 3 == 1, "Medium").otherwise("Low").alias("record_confidence"), (k % 3).alias("n_sources"), (k % 2).alias("n_signals"), (k % 5 != 0).alias("has_route"), (k % 800).alias("days"), F.when(k % 6 != 0, "t").alias("investment_thesis"))
    return C.fit(rows, True, True).select("s_suppkey", "fit_score", "uncertainty")


@query("""WITH x AS (SELECT c_custkey, (c_custkey % 1001) / 1000.0::DOUBLE AS c, c_custkey % 4 AS n FROM customer), b AS (SELECT *, CASE WHEN c >= 0.9 AND c < 1.01 THEN 'auto_release' WHEN c >= 0.85 AND c < 0.89 THEN 'auto_release_medium' WHEN c >= 0.7 AND c < 0.84 THEN 'hold_governance_review' ELSE 'quarantine' END AS band FROM x)
SELECT c_custkey, band, CASE WHEN n < 2 THEN 'refuse' WHEN c < 0.85 THEN 'escalate' WHEN band LIKE 'auto%' THEN 'autonomous' WHEN band = 'hold_governance_review' THEN 'escalate' ELSE 'refuse' END AS status FROM b""")
def bands(spark, d):
    """NUM-09 NUM-10 GOV-04: bands with their gaps"""
    rows = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 1001) / 1000.0).alias("c"), (F.col("c_custkey") % 4).alias("n"))
    return rows.select("c_custkey", M.release_band(F.col("c")).alias("band"), C.may_publish(F.col("c"), F.col("n")).alias("status"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS cosine FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    """NUM-05 SRT-01: one query vector against all"""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").first()
    return R.top(V.cosine_to(vectors if asked else vectors.limit(0), asked["embedding"] if asked else []), 10, F.desc("cosine"), "vec_id").select("vec_id", F.round("cosine", 6).alias("cosine"))


BM25_SQL = """q AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = 1), qt AS (SELECT term, count(*) AS qn FROM q GROUP BY term), t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
s AS (SELECT count(*)::DOUBLE AS nd, avg(len(toks)) AS mean FROM t), tf AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM t), c AS (SELECT doc_id, n, term, count(*) AS f FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
i0 AS (SELECT term, ln(nd - df + 0.5) - ln(df + 0.5) AS idf FROM df, s), i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
b AS (SELECT c.doc_id, sum(idf * qn * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * n / mean))) AS bm25 FROM c JOIN qt USING (term) JOIN i USING (term), s GROUP BY c.doc_id)"""


def _bm25(spark, d):
    asked = table(spark, d, "benchmark").where("item_id = 1").select(X.tokens(F.coalesce("text", F.lit(""))).alias("t")).first()
    return V.bm25(table(spark, d, "documents"), asked["t"] if asked else [])


@query(f"""WITH {BM25_SQL} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20""")
def bm25_topk(spark, d):
    """NUM-06"""
    return R.top(_bm25(spark, d).select("doc_id", F.round("bm25", 6).alias("bm25")), 20, F.desc("bm25"), "doc_id")


@query(f"""WITH {BM25_SQL}, r AS (SELECT d.doc_id, d.lang, d.n_chars, coalesce(round(bm25, 6), 0) AS bm25 FROM documents d LEFT JOIN b USING (doc_id) WHERE d.lang = 'en'), k AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS v, CASE WHEN bm25 > 0 THEN row_number() OVER (PARTITION BY bm25 > 0 ORDER BY bm25 DESC, doc_id) - 1 END AS br FROM r)
SELECT doc_id, round(1.0::DOUBLE / (60 + v) + coalesce(1.0::DOUBLE / (60 + br), 0.0), 9)::DOUBLE AS rrf FROM k ORDER BY 1.0::DOUBLE / (60 + v) + coalesce(1.0::DOUBLE / (60 + br), 0.0) DESC, doc_id LIMIT 20""")
def rrf_hybrid(spark, d):
    """RAG-01 NUM-07 WIN-01: idf over all documents, ranks over the filtered ones"""
    docs = table(spark, d, "documents")
    scores = docs.select("doc_id", F.col("n_chars").cast("double").alias("vector"), F.lit(0.0).alias("focus")).join(_bm25(spark, d), "doc_id", "left").withColumn("bm25", F.coalesce(F.round("bm25", 6), F.lit(0.0)))
    return V.hybrid(docs.select("doc_id", "lang"), scores, P.matches(lang="en"), k=20).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name), '7') AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def directory_sort(spark, d):
    """SRT-07 FLT-07"""
    rows = P.directory(table(spark, d, "customer").withColumn("fo_type", F.col("c_mktsegment")).withColumn("record_confidence", F.lit("")), "7", "BUILDING", None, ("c_name",))
    return R.top(rows, 25, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region""")
def union_distinct(spark, d):
    """SET-03 SET-05 SET-06"""
    return R.union_distinct(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("""SELECT 'orders' AS name, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels""")
def cycle_counts(spark, d):
    """AGG-25 AGG-26 CYC-10"""
    return A.table_sizes({t: table(spark, d, t) for t in ("orders", "documents", "pages", "labels")})


@query("""WITH c AS (SELECT n_name AS key, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, key LIMIT 12) SELECT key, n, round(n / max(n) OVER ()::DOUBLE, 4) AS share FROM c""")
def geo_distribution(spark, d):
    """AGG-15 AGG-28 SRT-09"""
    return A.share_of_most(table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name", 12)


@query("""SELECT source, count(*)::BIGINT AS found, count(*) FILTER (n_chars >= 500)::BIGINT AS qualified, count(*) FILTER (n_chars < 500)::BIGINT AS rejected FROM documents GROUP BY source""")
def yield_by_source(spark, d):
    """AGG-16 AGG-17"""
    return A.yield_by(table(spark, d, "documents"), "source", F.col("n_chars") >= 500)


@query(LABELLED + """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS category, count(*)::BIGINT AS n FROM dl GROUP BY 1""")
def categories(spark, d):
    """AGG-20"""
    return A.first_category(documents_with_labels(spark, d), [("unlabelled", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0)], "good")


@query("""SELECT d.lang AS lang, count(*)::BIGINT AS n, round(avg((l.quality = 1)::INT::DOUBLE), 4) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang""")
def accuracy_by_class(spark, d):
    """AGG-27 JOIN-11 JOIN-12"""
    return A.accuracy_by(table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id"), "lang", F.col("quality") == 1)


@query("""WITH g AS (SELECT o_orderdate::DATE AS day, count(*)::BIGINT AS n FROM orders GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change FROM g""")
def cycle_delta(spark, d):
    """WIN-07"""
    return R.delta(table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")), "day", "n")


@query("""WITH o AS (SELECT o_orderdate::DATE AS day, count(*)::BIGINT AS runs FROM orders GROUP BY 1), l AS (SELECT l_shipdate::DATE AS day, count(*)::BIGINT AS builds FROM lineitem GROUP BY 1) SELECT coalesce(o.day, l.day) AS day, coalesce(runs, 0)::BIGINT AS runs, coalesce(builds, 0)::BIGINT AS builds FROM o FULL JOIN l ON o.day = l.day""")
def history_by_day(spark, d):
    """MNT-16"""
    from ..operators.maintain import history

    return history(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@query(r"""SELECT c_custkey, CASE WHEN c_acctbal >= 1000000000 THEN 1 ELSE 0 END AS big, '$' || printf('%.1f', round(abs(c_acctbal) / 10.0, 1)) || 'M' AS shown, (CASE WHEN length(round(abs(c_acctbal), 0)::BIGINT::VARCHAR) > 0 THEN trunc(round(abs(c_acctbal) / 10.0, 1) * 1000000.0::DOUBLE) END)::BIGINT AS usd FROM customer""")
def money_round_trip(spark, d):
    """NUM-01 NUM-02 NUM-04: a figure as text and back"""
    v = F.round(F.abs("c_acctbal") / 10.0, 1)
    shown = F.concat(F.lit("$"), F.format_string("%.1f", v), F.lit("M"))
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") >= 1e9).cast("int").alias("big"), shown.alias("shown"), M.parse_aum_usd(shown).alias("usd"))


@query("""SELECT lang, count(*)::BIGINT AS n, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang""")
def qualified_scan(spark, d):
    """SRC-08 SRC-09 SRC-10: a filtered scan with a semi join"""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return table(spark, d, "documents").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""SELECT doc_id, lang, n_chars FROM (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n <= 10""")
def top_per_group(spark, d):
    """WIN-06: the ten shortest documents of each language"""
    return R.top_by_group(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", 10, "n_chars", "doc_id")


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS place FROM orders WHERE o_orderstatus = 'F'""")
def ranked_channel(spark, d):
    """WIN-01 SRT-02: places from 0 among the rows with signal"""
    rows = R.ranked(table(spark, d, "orders"), "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F", "place")
    return rows.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS id, c_name AS name FROM customer), t AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_custkey FROM c WHERE id IN (SELECT id FROM t WHERE id IS NOT NULL) OR (id IS NULL AND name IN (SELECT name FROM t WHERE id IS NULL))""")
def either_key_semi(spark, d):
    """JOIN-05: by id, by name only where the id is null"""
    key = F.col("c_custkey")
    customers = table(spark, d, "customer").select("c_custkey", F.when(key % 3 != 0, key).alias("id"), F.col("c_name").alias("name"))
    there = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == key).select(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("id"), F.col("c_name").alias("name"))
    return R.either_key_semi(customers, there, "id", "name").select("c_custkey")


@query("""SELECT doc_id, min(pass)::INTEGER AS pass FROM (SELECT doc_id, 0 AS pass FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars >= 1000) GROUP BY doc_id""")
def hits_first(spark, d):
    """SET-08: hits, then everything, each once"""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    hits = docs.where("lang = 'fr'").select("doc_id", F.lit(0).alias("pass"))
    return R.hits_first(hits, docs.where("n_chars >= 1000").select("doc_id", F.lit(1).alias("pass")), "doc_id", "doc_id")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+1 (' || substr((5550000000 + c_custkey)::VARCHAR, 1, 3) || ') ' || substr((5550000000 + c_custkey)::VARCHAR, 4, 3) || '-' || substr((5550000000 + c_custkey)::VARCHAR, 7, 4)
WHEN 1 THEN '+1 (' || substr((5550000000 + c_custkey)::VARCHAR, 1, 3) || ') ' || substr((5550000000 + c_custkey)::VARCHAR, 4, 3) || '-' || substr((5550000000 + c_custkey)::VARCHAR, 7, 4) ELSE c_custkey::VARCHAR END AS phone FROM customer""")
def phone_format(spark, d):
    """TXT-09"""
    n = (F.col("c_custkey") + 5_550_000_000).cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, n).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("1-"), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 7))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", X.phone(raw).alias("phone"))


@query("""SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND lower(n_name) = lower((SELECT min(n_name) FROM nation)) AND c_acctbal >= 100""")
def metadata_filter(spark, d):
    """FLT-02 FLT-03 FLT-04: hard filters on metadata"""
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.col("c_mktsegment").alias("fo_type"), F.col("n_name").alias("hq_country"), F.col("c_acctbal").cast("long").alias("aum_usd"), F.array(F.lower("c_mktsegment")).alias("sectors"))
    return rows.where(P.meta_matches({"fo_type": "BUILDING", "hq_country": (first or "").upper(), "aum_min": 100, "sectors": "build"})).select("c_custkey")


@query()
def html_text(spark, d):
    """HTM-01 HTM-02 HTM-03: the text, description and mail links of pages"""
    from ..functions.markup import page_facts

    return table(spark, d, "pages").select("page_id", page_facts(F.col("html")).alias("p")).select("page_id", F.length("p.text").alias("chars"), F.col("p.description").alias("description"), F.size("p.mailto").alias("links"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS end, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(sum(value::DECIMAL(38,6))::DOUBLE, 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """Extension: tumbling windows with a watermark, by the function that a stream uses too"""
    from ..streaming.events import tumbling

    return tumbling(table(spark, d, "events"))


from . import file_library, record_library  # noqa: E402, F401
