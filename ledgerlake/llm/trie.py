"""Operator 12: the trie of conversation prefixes, named by prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import discard, settle, shorter, small_batches, tidy

#: Conversations of one block of so many ids may share turns, and at most MOST - 1 of them.
BLOCK, MOST = 100, 6
#: Ids are joined to strings in stretches of so many, which bounds a row however many conversations end in a node.
STRETCH = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(table: DataFrame, name: str, first: int = 0) -> DataFrame:
    """A settled table with _id, of monotonically_increasing_id(), as one with name instead: numbers from first on, without gaps, in the order of _id."""
    part = F.shiftright("_id", 33)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") + F.lit(first)).alias("_begin"))  # a row for each task that wrote
    place = F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn("_part", part).join(F.broadcast(begins), "_part").withColumn(name, place.cast("long")).drop("_id", "_part", "_begin")


def named(rows: DataFrame, keys: list[str], first: int = 0) -> tuple[DataFrame, int]:
    """rows, settled, with name instead of keys: equal keys have one number, from first on without gaps; and the number after the last.

    The different keys are summed up in each task before they move, and the table of names is joined as a table of its
    own, so that adaptive execution splits a key which a third of the rows have.
    """
    different = settle(rows.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()))
    out = settle(rows.join(numbered(different, "name", first), keys).drop(*keys))
    n = different.count()
    discard(different)
    return out, first + n


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, fp, chars) for every turn, settled, and (conv_id, n), settled: turns by turn, role and text, null turns first.

    All rows are sorted by range, so a conversation's place in the order of all and a turn's place give the turn's place
    in it, and a conversation with a third of all rows is spread over tasks. fp is SHA-256 of role and text.
    """
    role, text, first = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("turn").asc_nulls_first()
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    sorted_ = rows.repartitionByRange("conv_id", first).sortWithinPartitions("conv_id", first, "role", "text")
    fp = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"), 256))
    placed = settle(sorted_.select("conv_id", fp.alias("fp"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("_id")))
    rows = numbered(placed, "place")
    convs = settle(rows.groupBy("conv_id").agg(F.min("place").alias("begin"), F.count("*").alias("n")))
    turns = settle(rows.join(convs.drop("n"), "conv_id").select("conv_id", (F.col("place") - F.col("begin")).alias("at"), "fp", "chars"))
    discard(placed)
    return turns, convs.drop("begin")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, fp, chars), settled, and (conv_id, last), last how many: the first h turns of the block's first conversation, then a conversation's own after its first h.

    h is the CRC-32 of the decimal conv_id modulo MOST, and a block's first conversation is conv_id - conv_id % BLOCK, the
    remainder having conv_id's sign. If that one has fewer turns all are taken, if it is absent none.
    """
    turns, convs = ordered_turns(conversations)
    there = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    plan = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")).join(there, "base", "left")
    taken = F.least("h", F.coalesce("_n", F.lit(0)))
    plan = settle(plan.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")))
    own = turns.join(plan, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "fp", "chars")
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("at") < MOST - 1)).withColumnRenamed("conv_id", "base")
    lent = heads.join(plan, "base").where("at < h").select("conv_id", "at", "fp", "chars")  # at most BLOCK borrowers
    out = settle(own.union(lent))
    discard(turns)
    return out, plan.select("conv_id", "last")


def prefix_names(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, d, last, name, total) for every conversation and number of turns d from 0: equal prefixes have one name, total is their code points.

    Turns are named, then, in rounds of joins, blocks of 2, 4, 8 turns that begin at a multiple of their length, by the
    names of their halves. A prefix of d turns is the prefix without d's lowest binary digit and one such block, so the
    same number of rounds, the longest blocks first, names all prefixes by pairs of names. No round holds a conversation
    together; each turn is in one block of each length and each prefix is named once.
    """
    spark, longest = turns.sparkSession, (turns.agg(F.max("at")).first()[0] or 0) + 1
    blocks = [named(turns.select("conv_id", "at", "fp", "chars"), ["fp"])[0]]
    while 2 << (len(blocks) - 1) <= longest:
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(half(0).alias("a"), half(1).alias("b"), F.sum("chars").alias("chars")).where("a IS NOT NULL AND b IS NOT NULL")
        blocks.append(named(pairs, ["a", "b"])[0])
    zero = F.lit(0).cast("long")
    prefixes, count = convs.select("conv_id", zero.alias("d"), "last", zero.alias("name"), zero.alias("total")), 1
    for k in reversed(range(len(blocks))):
        step = blocks[k].where("at % 2 = 0").select("conv_id", F.shiftleft("at", k).alias("d"), F.col("name").alias("b"), "chars")
        longer = prefixes.withColumnRenamed("name", "a").join(step, ["conv_id", "d"]).select("conv_id", (F.col("d") + (1 << k)).alias("d"), "last", "a", "b", (F.col("total") + F.col("chars")).alias("total"))
        rows, count = named(longer, ["a", "b"], count)
        prefixes = prefixes.unionByName(rows)
    prefixes = settle(prefixes)
    for b in blocks:
        discard(b)
    return prefixes


def digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256), settled, from ends(name, conv_id): SHA-256 of the ids in ascending order, joined by commas.

    Ids meet in stretches of STRETCH; a task reads a node's stretches in order and holds one batch of them at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    stretches = ends.groupBy("name", F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(ids.alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in shorter(batches):
            names, sums = [], []
            for name, part in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if name == now:
                    digest.update(b"," + part.encode())
                    continue
                if now is not None:
                    names.append(now)
                    sums.append(digest.hexdigest())
                now, digest = name, hashlib.sha256(part.encode())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sums, pa.string())], ["name", "ends_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["name", "ends_sha256"])

    with small_batches(ends.sparkSession):
        return settle(stretches.repartition("name").sortWithinPartitions("name", "stretch").select("name", "ids").mapInArrow(tidy(read), "name long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie: name, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv_id, at, fp, chars) with at from 0 without gaps, convs(conv_id, last), a row for each id, last its number of
    turns. A node belongs to its smallest member, and with it all that the member has below it: a conversation owns its
    prefixes from some length on. So what a subtree holds is a sum over the members of its top, of numbers that each
    conversation knows: how many code points stand in prefixes that it does not own, and whether it owns the leaf it ends
    in. All counts are thus one sum by node over the prefixes, and no path is walked. Without conversations there is no
    node.
    """
    prefixes = prefix_names(turns, convs)
    ends = F.col("d") == F.col("last")
    nodes = settle(prefixes.groupBy("name").agg(F.min("conv_id").alias("node"), F.max("d").alias("depth"), F.max("total").alias("total"), F.count("*").alias("n_convs"), F.sum(ends.cast("long")).alias("n_ends")))
    rows = settle(prefixes.join(nodes.select("name", "node", (F.col("n_ends") == F.col("n_convs")).alias("leaf")), "name"))
    owned = F.col("node") == F.col("conv_id")
    own = settle(rows.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(~owned, F.col("d"))), F.lit(-1)).alias("shared"),
        F.coalesce(F.max(F.when(~owned, F.col("total"))), F.lit(0)).alias("spared"),
        F.max((ends & owned & F.col("leaf")).cast("long")).alias("ends_leaf")))
    sums = rows.join(own, "conv_id").groupBy("name").agg(
        F.sum(((F.col("d") < F.col("last")) & (F.col("d") >= F.col("shared"))).cast("long")).alias("n_children"),
        F.sum("ends_leaf").alias("n_leaves"), F.sum(F.greatest(F.col("spared") - F.col("total"), F.lit(0))).alias("below"))
    above = rows.select("conv_id", (F.col("d") + 1).alias("d"), F.col("node").alias("parent_conv_id"), F.col("total").alias("before"))
    parents = rows.where(owned & (F.col("d") > 0)).select("conv_id", "d", "name").join(above, ["conv_id", "d"]).drop("conv_id", "d")
    out = nodes.join(sums, "name").join(parents, "name", "left").join(digests(rows.where(ends).select("name", "conv_id")), "name", "left")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("total") - F.coalesce("before", F.lit(0)))
    return out.select("name", F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the rebuilt conversations.

    conversations(conv_id, turn, role, text): null turns come first, null role and text are empty; turns of one number are
    ordered by role and text, and repeated rows are repeated turns. Rows without a conv_id belong to no conversation and
    are left out. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    return prefix_trie(*rebuilt(conversations))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("name")


#: CRC-32 is taken bit by bit; a sequence is named by the digests of its turns.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS fp, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
    xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
        lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON c.base = b.conv_id),
r AS (SELECT conv_id, i - h + taken AS i, fp, chars FROM t JOIN p USING (conv_id) WHERE i >= h
    UNION ALL SELECT p.conv_id, i, fp, chars FROM t JOIN p ON t.conv_id = p.base WHERE i < h),
x AS (SELECT conv_id, i + 1 AS d, chars, sha256(string_agg(fp, '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i)) AS name,
    coalesce(sha256(string_agg(fp, '' ORDER BY i) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS parent FROM r
    UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM x),
n AS (SELECT name, d, parent, chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY ALL),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.parent = n.name) AS n_children FROM n LEFT JOIN n u ON n.parent = u.name),
s AS (SELECT x.name, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.chars) AS saved FROM k JOIN x ON k.conv_id = x.conv_id AND x.d <= k.d GROUP BY x.name)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM k JOIN s USING (name)
"""
