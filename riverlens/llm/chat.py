"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A logger that stores a conversation after every turn leaves snapshots that are prefixes of longer
ones. Each turn gets a hash of its place, role and text; the running XOR of these up to a turn is the
hash of that prefix. A conversation whose whole hash is a prefix hash of a longer one goes, of equal
ones the one with the least id stays, and the rest are rendered.

Defined cases: turns are ordered by number (nulls last), then by their hashes; a null role or text is
empty; a null id is a conversation of its own, and is kept if nothing longer continues it; a repeated
row is one more turn; very long texts and conversations are hashed and rendered whole; an empty table
gives an empty result. Only the four named columns are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns whose order and running hash one window works out; longer conversations are pieced together.
CHUNK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(2**62)).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, h, g: hashes (two of 64 bits) of each conversation's first k turns. Windows cover
    chunks of turns, and a second window the chunks of a conversation, so a conversation of any
    length is dealt over many tasks."""
    t = turns.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit("|"), "role").alias("b"), F.floor(F.col("turn") / CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "a", "b")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("size")).withColumn("skip", F.coalesce(F.sum("size").over(before), F.lit(0)))
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "skip")
    same = lambda x: F.col("conv_id").eqNullSafe(x["_c"]) & (F.col("chunk") == x["_k"])
    p = t.withColumn("i", F.row_number().over(inside)).join(sizes, same(sizes)).withColumn("k", F.col("skip") + F.col("i")).drop("_c", "_k")
    p = p.select("conv_id", "chunk", "k", F.xxhash64("k", "a").alias("a"), F.xxhash64("b", "k").alias("b"))
    run = Window.partitionBy("conv_id", "chunk").orderBy("k")
    whole = p.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = whole.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"_{x}") for x in "ab"))
    p = p.withColumn("x", F.bit_xor("a").over(run)).withColumn("y", F.bit_xor("b").over(run)).join(whole, same(whole))
    return p.select("conv_id", "k", F.expr("x ^ _a").alias("h"), F.expr("y ^ _b").alias("g"))


def maximal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay. Equal conversations and equal
    prefixes are summed up in each task before they are shuffled."""
    p = cut(prefixes(_turns(conversations, conv, turn, role, text)), "prefixes")
    full = p.groupBy("conv_id").agg(F.max(F.struct("k", "h", "g")).alias("m")).select("conv_id", "m.*")
    longest = full.select(F.col("conv_id").alias("_c"), F.col("k").alias("_n"))
    inner = p.join(longest, p.conv_id.eqNullSafe(longest["_c"])).where("k < _n").select("k", "h", "g").distinct()
    kinds = full.groupBy("k", "h", "g").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return kinds.join(inner, ["k", "h", "g"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations as one text each."""
    keep = cut(maximal(conversations, conv, turn, role, text), "maximal")
    t = _turns(conversations, conv, turn, role, text)
    t = t.join(keep.select(F.col("conv_id").alias("_c")), t.conv_id.eqNullSafe(F.col("_c")), "left_semi")
    said = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    order = F.struct("turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit("|"), "role").alias("b"), said.alias("said"))
    r = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["said"]), "").alias("rendered"))
    r = r.withColumnRenamed("conv_id", "_c")
    return keep.join(r, keep.conv_id.eqNullSafe(r["_c"])).select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE_SQL = r"""
with c as (select conv_id, list('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) order by turn) as l from conversations group by 1),
k as (select l, min(conv_id) as conv_id, count(*) as n_copies, l[1] as f from c group by l),
p as (select distinct a.conv_id from k a join k b on a.f = b.f and len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l)
select conv_id, len(l)::bigint as n_turns, n_copies, array_to_string(l, '') as rendered from k where conv_id not in (select conv_id from p)
"""
