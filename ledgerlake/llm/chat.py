"""Operator 7: chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template. A message is OPEN role SHUT text [NEXT text ...] CLOSE; adjacent turns of one role share a message.
OPEN, SHUT, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>\n"
#: Escapes inside roles and texts: after them no text holds < or >, so no text can hold a mark of the template.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
#: Places are summed within blocks of so many texts, then over the blocks, so a long conversation does not cost the square of its turns.
BLOCK = 256


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted string and loss, an array of (start, length) in code points of the texts to train on.

    turns(conv_id, turn, role, text): turns are sorted by turn, then role, then text; null turn comes first, null role
    and null text are empty, a null conv_id is a conversation. Repeated rows are repeated turns. Adjacent turns of one
    role are merged into one message that keeps the seams. An empty table gives no rows; other columns are ignored.
    A conversation is one output row, so its turns meet in one task; that bound is the conversation's own length.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    role = lambda i: F.get("turns", i).role
    n = F.size("turns")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    rows = rows.withColumn("_from", begins)

    def message(i: Column, at: Column) -> Column:
        end = F.coalesce(F.get("_from", at + 1), n)
        return F.struct(role(i).alias("role"), F.transform(F.slice("turns", i + 1, end - i), lambda t: t.text).alias("texts"))

    # A piece is what stands before a text, the text, and what stands after it.
    def pieces(m: Column) -> Column:
        n = F.size(m.texts)
        return F.transform(m.texts, lambda t, i: F.struct(
            F.when(i == 0, F.concat(F.lit(OPEN), escape(m.role), F.lit(SHUT))).otherwise(F.lit(NEXT)).alias("head"),
            escape(t).alias("body"),
            F.when(i == n - 1, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            (m.role == trained_role).alias("trained")))

    rows = rows.withColumn("messages", F.transform("_from", message))
    rows = rows.withColumn("pieces", F.flatten(F.transform("messages", pieces)))
    rows = rows.withColumn("_sizes", F.transform("pieces", lambda p: F.struct(*[F.char_length(p[x]).cast("long").alias(x) for x in ("head", "body", "tail")], p.trained.alias("trained"))))
    rows = rows.withColumn("_blocks", _blocks(F.col("_sizes")))
    rows = rows.withColumn("_lengths", F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + p.head + p.body + p.tail)))

    def after(acc: Column, length: Column) -> Column:
        return F.struct((acc.at + length).alias("at"), F.concat(acc.begins, F.array(acc.at)).alias("begins"))

    def place(acc: Column, p: Column) -> Column:
        begin = acc.at + p.head
        span = F.struct(begin.alias("start"), p.body.alias("length"))
        return F.struct((begin + p.body + p.tail).alias("at"), F.when(p.trained, F.concat(acc.loss, F.array(span))).otherwise(acc.loss).alias("loss"))

    begins = F.aggregate("_lengths", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("begins")), after).begins
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    return rows.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, p.tail)), "").alias("formatted"),
        F.flatten(F.zip_with("_blocks", begins, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("loss")), place).loss)).alias("loss"),
    )


def _blocks(items: Column) -> Column:
    """An array in pieces of BLOCK, at least one: what appends to an array, or seeks in a text, does so within a piece."""
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    messages = F.filter(F.split(formatted, "</turn>\n"), lambda m: m != "")

    def turns(m: Column) -> Column:
        cut = F.instr(m, F.lit(SHUT))
        role = unescape(F.substring(m, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1)))
        return F.transform(F.split(F.substring(m, cut + 1, F.char_length(m)), NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A place in a text is found by counting from its start, so the stretch of each block of spans is cut out once.
    """
    end = lambda s: s.start + s.length
    cut = lambda text, start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))
    stretches = F.transform(
        F.filter(_blocks(loss), lambda b: F.size(b) > 0),
        lambda b: F.struct(b.alias("spans"), F.get(b, F.lit(0)).start.alias("base"), cut(formatted, F.get(b, F.lit(0)).start, end(F.element_at(b, -1)) - F.get(b, F.lit(0)).start).alias("text")),
    )
    said = F.transform(stretches, lambda x: F.array_join(F.transform(x.spans, lambda s: unescape(cut(x.text, s.start - x.base, s.length))), ""))
    return F.array_join(said, "")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = format_conversations(turns.unionByName(extra))
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
seams AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS joins,
    replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS safe_role, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS safe_text FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(safe_text) + CASE WHEN joins THEN length('<next>') ELSE length('<turn >') + length(safe_role) + length('</turn>') + 1 END)::BIGINT AS formatted_chars
FROM seams GROUP BY conv_id
"""
