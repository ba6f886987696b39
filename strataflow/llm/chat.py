"""Chat formatting after collapsing cumulative snapshots.

Loggers often store a conversation again after every turn. A rolling hash of each conversation's turn
prefixes (an order-dependent 128-bit combination that is built with running XORs, so no conversation is
ever gathered) identifies every conversation that is a prefix of a longer one: it is removed by an
anti-join; of equal conversations the one with the smallest conv_id stays. The remaining, maximal
conversations are rendered turn by turn.

Turns are ordered by turn, then role, then text; a null role or text counts as empty. Long
conversations are hashed in chunks of turn numbers and every join is by chunk or position, so a single
conv_id with very many turns is spread over tasks; turns that share one number are ordered in one task,
which spills. Very long texts are rendered whole. Rendering gives one row per turn: ``<|role|>\\ntext<|end|>\\n`` with its position and
whether it is a training target (assistant turns). Repeated rows are turns of their own. Rows with a
null conv_id belong to no conversation and are dropped from the result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turn numbers per chunk of a conversation.
CHUNK = 1000


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, position (0-based), role, text and the two hashes of the prefix that ends here."""
    clean = turns.filter("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = clean.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = clean.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))).join(offsets, ["conv_id", "chunk"]).withColumn("position", F.col("offset") + F.col("rank") - 1)
    # position-dependent turn hashes make the XOR of a prefix depend on order
    hashed = placed.withColumns({"h1": F.xxhash64(F.lit(1), "position", "role", "text"), "h2": F.xxhash64(F.lit(2), "text", "position", "role")})
    sums = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    carried = sums.select("conv_id", "chunk", F.coalesce(F.bit_xor("c1").over(earlier), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("c2").over(earlier), F.lit(0)).alias("c2"))
    rolling = hashed.withColumns({"r1": F.bit_xor("h1").over(inside), "r2": F.bit_xor("h2").over(inside)}).join(carried, ["conv_id", "chunk"])
    return rolling.select("conv_id", "chunk", "position", "role", "text", F.col("r1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("p2"))


def maximal(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The turns, with positions, of conversations that are a prefix of no other one."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    rolled = scratch.keep(positions(turns), "prefixes")
    whole = rolled.groupBy("conv_id").agg(F.max(F.struct("position", "p1", "p2")).alias("last")).select("conv_id", "last.*")
    # copies first: one conversation per full hash, so what follows sees each content once
    first = whole.groupBy("position", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    # proper prefixes of any conversation, each once; a hot prefix is one row after this aggregation
    proper = rolled.join(whole.select("conv_id", "position"), ["conv_id", "position"], "left_anti").groupBy("position", "p1", "p2").agg(F.count("*").alias("n"))
    kept = first.join(proper.drop("n"), ["position", "p1", "p2"], "left_anti").select("conv_id")
    # by chunk, so that no join gathers a long conversation
    chunks = rolled.select("conv_id", "chunk").distinct().join(kept, "conv_id", "left_semi")
    return rolled.join(chunks, ["conv_id", "chunk"], "left_semi").drop("p1", "p2", "chunk")


def render(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per turn of a maximal conversation: conv_id, position, rendered, is_target."""
    role, text = F.col("role"), F.col("text")
    return maximal(turns, scratch).select("conv_id", F.col("position").cast("long").alias("position"), F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n")).alias("rendered"), (role == "assistant").alias("is_target"))
