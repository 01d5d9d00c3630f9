"""Chat formatting: collapse cumulative snapshots, then render, with DataFrame functions only.

Logged conversations often grow: the same dialogue is stored again after every
turn. A rolling hash of each turn prefix identifies the logs that are a prefix of
a longer one; two anti-joins keep the maximal conversations, one log per equal set.

Defined results: turns are ordered by turn (nulls first), then role, then text; a
null role reads "unknown", a null text is empty; repeated rows are repeated turns;
a null conv_id is one conversation of its own; an empty table gives no rows; other
columns are ignored. A conversation of more than ``PART`` turn numbers is rendered
in parts (one row per block of turn numbers, ``part`` ascending), so that no row or
task holds an unbounded conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpflow.session import read_table, scratch_path

PART = 512
#: Before the role, between role and text, after the text of a rendered turn.
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def ordered_turns(conversations: DataFrame, part: int = PART) -> DataFrame:
    """Turns with their rank and prefix hash in the conversation.

    Ranks and prefix hashes are running totals in two levels: within (conversation,
    block of turn numbers), then over the few block totals. A conversation holding
    a third of all rows is so spread over its blocks. The prefix hash is the xor of
    hash(rank, role, text) up to the turn, taken with two seeds (128 bits).
    """
    t = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part), F.lit(-(2**62))).cast("long").alias("block"),
    )
    # every row_number below runs inside one block
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("at", F.row_number().over(order))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(over), F.lit(0)).alias("before")
    )
    t = t.join(starts, t.conv_id.eqNullSafe(starts.c) & (t.block == starts.b)).drop("c", "b")
    t = t.withColumn("rank", F.col("at") + F.col("before"))
    return t.withColumn("h1", F.xxhash64("rank", "role", "text")).withColumn(
        "h2", F.xxhash64(F.lit(1), "text", "role", "rank")
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per turn: (conv_id, rank, p1, p2) with the xor of h1/h2 up to that turn."""
    within = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = turns.select(
        "conv_id", "block", "rank", F.bit_xor("h1").over(within).alias("x1"), F.bit_xor("h2").over(within).alias("x2")
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    blocks = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.bit_xor("b1").over(over), F.lit(0)).alias("s1"),
        F.coalesce(F.bit_xor("b2").over(over), F.lit(0)).alias("s2"),
    )
    j = local.join(blocks, local.conv_id.eqNullSafe(blocks.c) & (local.block == blocks.b))
    return j.select(
        "conv_id", "rank", F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logs) of the conversations that are no proper prefix of another;
    of equal ones the smallest conv_id stays (null last) and n_logs counts them."""
    totals = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2")
    )
    # equal logs become one row before any join: a hot group of copies is one key
    full = totals.groupBy("n_turns", "t1", "t2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logs"))
    prefixes = prefix_hashes(turns)
    ends = totals.select(F.col("conv_id").alias("c"), F.col("n_turns").alias("total"))
    # anti-join 1: a conversation's last prefix is itself, not a proper prefix
    proper = prefixes.join(ends, prefixes.conv_id.eqNullSafe(ends.c) & (prefixes["rank"] == ends.total), "left_anti")
    proper = proper.select(F.col("rank").alias("n_turns"), F.col("p1").alias("t1"), F.col("p2").alias("t2")).distinct()
    # anti-join 2: drop what is a proper prefix of a longer log
    return full.join(proper, ["n_turns", "t1", "t2"], "left_anti").select("conv_id", "n_turns", "n_logs")


def render(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """One row per (conv_id, part): its turns by rank, each through the template."""
    before, between, after = map(F.lit, template)
    one = F.concat(before, F.col("role"), between, F.col("text"), after)
    return turns.groupBy("conv_id", "block").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank"), one.alias("t")))), lambda x: x.getField("t")), ""
        ).alias("rendered"),
        F.min("rank").alias("first_turn"),
    )


def format_chats(conversations: DataFrame, part: int = PART) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, first_turn, n_turns, n_logs, rendered."""
    spark = conversations.sparkSession
    path = scratch_path(spark, "chat-turns")
    ordered_turns(conversations, part).write.parquet(path)
    turns = spark.read.parquet(path)
    # only numbers and hashes are read for the collapse; texts come back for kept conversations
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("c"), "n_turns", "n_logs")
    stay = turns.join(kept, turns.conv_id.eqNullSafe(kept.c), "left_semi")
    parts = render(stay)
    out = parts.join(kept, parts.conv_id.eqNullSafe(kept.c))
    return out.select(
        "conv_id",
        F.when(F.col("block") < 0, F.lit(-1)).otherwise(F.col("block")).cast("long").alias("part"),
        F.col("first_turn").cast("long"),
        F.col("n_turns").cast("long"),
        F.col("n_logs").cast("long"),
        "rendered",
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "part", "first_turn", "n_turns", "n_logs", F.sha2(F.col("rendered"), 256).alias("rendered_sha256"), "rendered"
    )


OP9_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as rank
  from conversations),
c as (
  select conv_id, count(*) as n_turns, list(role || chr(0) || text order by rank) as seq from t group by conv_id),
p as (
  select distinct c.seq[1:x.k] as seq from c, lateral (select unnest(range(1, c.n_turns)) as k) x),
m as (
  select min(conv_id) as conv_id, seq, count(*) as n_logs from c group by seq),
kept as (select m.* from m anti join p on m.seq = p.seq),
r as (
  select t.conv_id, cast(floor(turn / 512) as bigint) as part, min(rank) as first_turn,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by rank) as rendered
  from t join kept on kept.conv_id = t.conv_id group by 1, 2)
select r.conv_id, r.part, r.first_turn, cast(len(kept.seq) as bigint) as n_turns, kept.n_logs,
       sha256(r.rendered) as rendered_sha256, r.rendered
from r join kept on kept.conv_id = r.conv_id
"""
