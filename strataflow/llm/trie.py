"""Conversation prefix trie by preorder intervals.

A node is a distinct sequence of the first d turns of some conversation; what conversations share is stored,
tokenised or computed once. The trie is never walked:

1. *Positions.* Turns get their place in their conversation from a global sort dealt to ranges and the sizes
   of the ranges before, so a conversation with very many turns is spread over tasks.
2. *Lexicographic ranks.* A turn is a 16-byte digest of its role and text. The key of (conversation, depth) is
   the sequence of digests of its block of 64 turns up to there; distinct keys are ranked by a range sort. Where
   conversations are longer than a block, the ranks of the blocks before and the row's own rank are the
   symbols of the next round, whose blocks are 64 times as long, so keys stay short and the rounds are the
   logarithm, to base 64, of the greatest depth. The last ranks number the distinct nodes in preorder.
3. *Intervals.* A node's subtree ends at the greatest position at which one of its conversations ends.
4. *Sums.* Leaves and savings of subtrees are differences of prefix sums over the preorder, at the interval's
   end and before its begin.

The members that end at a node are hashed as a stream: range-sorted tasks join ids to short pieces, and the
pieces of a node are hashed in order, one Arrow batch at a time.

Edge cases: null role and text count as empty; turns are ordered by turn, null first, and turns of one number
by role, then text; repeated rows are turns of their own. Rows with a null conv_id belong to no conversation.
Very long texts are digested whole. A conversation without turns ends at the root; an empty table has no nodes
(and no root). Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered, prefix_sums
from .common import Scratch

#: log2 of the turns of a block.
BLOCK_BITS = 6
#: Most ids in a piece of a node's list.
PIECE = 512


@dataclass(frozen=True)
class Params:
    """``block_bits``: log2 of the symbols of a sort key; ``piece``: ids joined before they are hashed."""

    block_bits: int = BLOCK_BITS
    piece: int = PIECE


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, position (1-based), symbol, words of every turn; the text goes along only where it orders turns of
    one number."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    tied = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    tied = scratch.keep(tied, "tied")
    symbol = F.unhex(F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    if not tied.isEmpty():
        turns = turns.join(tied, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").withColumn("tie", F.when(F.col("c").isNotNull(), F.col("text")))
    else:
        turns = turns.withColumn("tie", F.lit(None).cast("string"))
    rows = turns.select("conv_id", "turn", F.when(F.col("tie").isNotNull(), F.col("role")).alias("role"), "tie", symbol.alias("symbol"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    return numbered(rows, order, "g", lambda d: scratch.keep(d, "ordered")).select("conv_id", "g", "symbol", "words")


def rebuilt(conversations: DataFrame, base: Column | None, shared: Column | None, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns (conv_id, p, len, symbol, words).

    With ``base`` and ``shared`` (columns over conv_id; at most ``most`` turns), a conversation's first ``shared``
    turns are those of the conversation ``base``.
    """
    turns = ordered(conversations, scratch)
    convs = turns.groupBy("conv_id").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    if base is None:
        lens = scratch.keep(convs.select("conv_id", "start", F.col("n").alias("len")), "conversations")
        return lens.select("conv_id", "len"), turns.join(lens, "conv_id").select("conv_id", (F.col("g") - F.col("start") + 1).alias("p"), "len", "symbol", "words")
    own = convs.select("conv_id", "start", "n", base.alias("base"), shared.cast("long").alias("h"))
    first = turns.join(convs.filter(base == F.col("conv_id")), "conv_id").filter(F.col("g") < F.col("start") + most)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("g", "symbol", "words"))).alias("head"))  # at most ``most`` turns each
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<g:bigint,symbol:binary,words:bigint>>"))
    given = own.join(heads, "base", "left").withColumn("head", head).withColumn("m", F.size("head").cast("long"))
    lens = scratch.keep(given.select("conv_id", "start", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    taken = lens.select("conv_id", "len", F.posexplode("head").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("p"), "len", "t.symbol", "t.words")
    rest = turns.join(lens.drop("head"), "conv_id").withColumn("at", F.col("g") - F.col("start") + 1).filter("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("m")).alias("p"), "len", "symbol", "words")
    return lens.select("conv_id", "len"), taken.unionByName(rest)


def _joined(columns: Column) -> Column:
    return F.aggregate(columns, F.lit(b""), lambda a, x: F.concat(a, x))


def ranks(turns: DataFrame, params: Params, scratch: Scratch) -> DataFrame:
    """(conv_id, p, len, words, pos): ``pos`` numbers the distinct prefixes in lexicographic order from 1."""
    block = F.shiftright(F.col("p") - 1, params.block_bits)
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = scratch.keep(turns.withColumn("block", block).withColumn("key", _joined(F.collect_list("symbol").over(upto("conv_id", "block").orderBy("p")))).drop("block", "symbol"), "keys")
    deepest = rows.agg(F.max("p")).first()[0] or 0
    bits = params.block_bits
    while True:
        names = numbered(rows.select("key").distinct(), [F.col("key")], "name", lambda d: scratch.keep(d, "names"))
        named = scratch.keep(rows.join(names, "key").select("conv_id", "p", "len", "words", (F.col("name") + 1).alias("pos")), "named")
        scratch.drop(rows)
        if deepest <= 1 << bits:
            return named
        symbol = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))  # noqa: E731  eight bytes, in numeric order
        ends = named.filter(F.col("p") % (1 << bits) == 0).select("conv_id", (F.shiftright("p", bits) - 1).alias("b"), symbol("pos").alias("s"))
        ends = ends.withColumn("over", F.shiftright("b", params.block_bits)).withColumn("past", _joined(F.collect_list("s").over(upto("conv_id", "over").orderBy("b"))))
        past = ends.select("conv_id", (F.col("b") + 1).alias("b"), "past").filter(F.col("b") % (1 << params.block_bits) != 0)
        with_past = named.withColumn("b", F.shiftright(F.col("p") - 1, bits)).join(past, ["conv_id", "b"], "left")
        rows = scratch.keep(with_past.select("conv_id", "p", "len", "words", F.concat(F.coalesce("past", F.lit(b"")), symbol("pos")).alias("key")), "keys")
        scratch.drop(named)
        bits += params.block_bits


PIECES = pa.schema([("pos", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
HASHES = pa.schema([("pos", pa.int64()), ("ends_sha256", pa.string())])


def _pieces(most: int):
    def join(batches):
        pos, ids, out = None, [], []

        def table():
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(PIECES)], schema=PIECES)

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (p != pos or len(ids) == most):
                    out.append((pos, ids[0], ",".join(map(str, ids)).encode()))
                    ids = []
                pos = p
                ids.append(c)
            if len(out) >= 1024:
                yield table()
                out = []
        if ids:
            out.append((pos, ids[0], ",".join(map(str, ids)).encode()))
        if out:
            yield table()

    return join


def _hashes(batches):
    pos, state, out = None, None, []

    def table():
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(HASHES)], schema=HASHES)

    for batch in batches:
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if p == pos:
                state.update(b"," + ids)
                continue
            if state is not None:
                out.append((pos, state.hexdigest()))
            pos, state = p, hashlib.sha256(ids)
        if len(out) >= 4096:
            yield table()
            out = []
    if state is not None:
        out.append((pos, state.hexdigest()))
    if out:
        yield table()


def list_hashes(ends: DataFrame, most: int = PIECE) -> DataFrame:
    """(pos, ends_sha256) of each position's conv_ids, ascending and comma-joined in decimal."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pos", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pieces(most), "pos long, first long, ids binary")
    return pieces.repartition(n, "pos").sortWithinPartitions("pos", "first").mapInArrow(_hashes, "pos long, ends_sha256 string")


def trie(conversations: DataFrame, base: Column | None = None, shared: Column | None = None, most: int = 0, params: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """One row per node: pos and stop (its preorder interval), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    scratch = scratch or Scratch(conversations.sparkSession, "trie")
    convs, turns = rebuilt(conversations, base, shared, most, scratch)
    placed = ranks(turns, params, scratch)
    last = placed.filter("p = len").select("conv_id", F.col("pos").alias("stop"))
    below = placed.join(last, "conv_id").groupBy("pos").agg(F.max("stop").alias("stop"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p").alias("depth"), F.max("words").alias("words"))
    up = placed.select("conv_id", (F.col("p") + 1).alias("depth"), F.col("pos").alias("parent"))
    nodes = scratch.keep(below.join(up, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0))), "nodes")
    total = nodes.count()
    # the root: all conversations, no text
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pos"), F.lit(total).cast("long").alias("stop"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent"))
    every = scratch.keep(nodes.unionByName(root), "every")
    counted = every.select("pos", "stop", (F.col("stop") == F.col("pos")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    sums = scratch.keep(prefix_sums(counted, "pos", ["leaf", "saving"], total + 1), "sums")
    begins = sums.select("pos", "stop", (F.col("leaf_sum") - F.col("leaf")).alias("leaf_0"), (F.col("saving_sum") - F.col("saving")).alias("saving_0"))
    closes = sums.select(F.col("pos").alias("stop"), F.col("leaf_sum").alias("leaf_1"), F.col("saving_sum").alias("saving_1"))
    spans = begins.join(closes, "stop").select("pos", (F.col("leaf_1") - F.col("leaf_0")).alias("n_leaves"), (F.col("saving_1") - F.col("saving_0")).alias("saved_tokens"))
    children = every.filter("parent is not null").groupBy(F.col("parent").alias("pos")).agg(F.count("*").alias("n_children"))
    heads = every.select(F.col("pos").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = list_hashes(last.select("conv_id", F.col("stop").alias("pos")).unionByName(convs.filter("len = 0").select("conv_id", F.lit(0).cast("long").alias("pos"))), params.piece)
    joined = every.join(heads, "parent", "left").join(spans, "pos").join(children, "pos", "left").join(ends, "pos", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "pos", "stop", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
