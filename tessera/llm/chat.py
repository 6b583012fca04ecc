"""Chat formatting with collapse of cumulative snapshots.

A logged conversation often appears many times, each time with a few turns more. Every turn gets a rolling hash of
all turns up to it; a conversation whose last hash is another one's inner hash is a snapshot of it. Snapshots go by
anti-join, exact repeats keep the smallest id, and the maximal conversations are rendered. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the rendered format. Fixed values.
START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per turn with its place, the rolling hash of the turns so far, and the conversation's length.

    Turns are ordered by (turn, role, text), null turn numbers last; a row that repeats another of its conversation
    in all three is a logging repeat and counts once. Null roles and texts are empty strings. Rows whose conv_id is
    null are one conversation.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    this = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.coalesce(F.lag(this).over(order).eqNullSafe(this), F.lit(False))).filter(~F.col("again")).drop("again")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("h1", F.bit_xor(F.xxhash64(F.lit(17), "pos", "role", "text")).over(so_far))
    rows = rows.withColumn("h2", F.bit_xor(F.xxhash64(F.lit(91), "text", "pos", "role")).over(so_far))
    return rows.withColumn("n", F.max("pos").over(Window.partitionBy("conv_id")))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each conversation that no other one continues.

    Columns: conv_id, n_turns, turns (array of role, text), n_same (conversations of these very turns, itself
    included; the smallest id stands for them). Two conversations are compared by 128 bits of rolling hashes over
    place, role and text. Prefixes are made distinct before the anti-join, so a first turn that millions of
    conversations share is one row of it. An empty table gives no rows.

    Turns are ordered by (turn, role, text), null turn numbers last; a row that repeats another of its conversation counts
    once; null roles and texts are empty; rows without conv_id are one conversation. A conversation is one row of the
    result, so its turns meet in one task, however many they are. Other columns, whatever their names, are neither read
    nor returned.
    """
    turns = _turns(conversations)
    whole = turns.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max_by("h1", "pos").alias("h1"),
        F.max_by("h2", "pos").alias("h2"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    heads = whole.groupBy("n_turns", "h1", "h2").agg(F.min_by(F.struct("conv_id", "turns"), F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("head"), F.count(F.lit(1)).alias("n_same"))
    inner = turns.filter(F.col("pos") < F.col("n")).groupBy(F.col("pos").alias("p"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).agg(F.max("n").alias("longest"))
    left = heads.join(inner, (F.col("n_turns") == F.col("p")) & (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left_anti")
    return left.select("head.conv_id", F.col("n_turns").cast("long").alias("n_turns"), "head.turns", F.col("n_same").cast("long").alias("n_same"))


def render(turns: Column) -> Column:
    """Turns as one string: control string, role, newline, text, control string. Control strings inside roles or
    texts are broken by a blank after their first character, so a text can't open or close a turn."""
    clean = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", r"< |$1|>")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(END))), "\n")


def format_chat(conversations: DataFrame) -> DataFrame:
    """Maximal conversations rendered: conv_id, n_turns, n_same, rendered. See maximal_conversations for odd rows."""
    return maximal_conversations(conversations).select("conv_id", "n_turns", "n_same", render(F.col("turns")).alias("rendered"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role, text) AS turns, count(*) AS n
  FROM d GROUP BY conv_id),
h AS (SELECT min(conv_id) AS conv_id, turns, any_value(n) AS n, count(*) AS n_same FROM c GROUP BY turns),
m AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > h.n AND c.turns[1:h.n] = h.turns))
SELECT conv_id, n::BIGINT AS n_turns, n_same::BIGINT AS n_same,
       array_to_string(list_transform(turns, lambda t: '<|im_start|>' || regexp_replace(t.role, '<\|(im_start|im_end)\|>', '< |\1|>', 'g')
         || chr(10) || regexp_replace(t.text, '<\|(im_start|im_end)\|>', '< |\1|>', 'g') || '<|im_end|>'), chr(10)) AS rendered
FROM m
"""
