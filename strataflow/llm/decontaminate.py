"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are lower-cased runs of letters and digits. A mask is a fixed set of offsets; its hash at a
position covers only the tokens at those offsets, so a substituted word at an ignored offset changes
nothing. ``placed_masks`` adds to the fixed masks, for each length of judged window, until every pattern
of substitutions that the acceptance rule allows leaves some mask whole at some position. Hashes of all benchmark positions are joined with the hashes of all
positions of all documents; each hit fixes an alignment (a diagonal), along which tokens are compared.
A document leaks an item when some ``window`` consecutive item tokens (the whole item if it is shorter)
agree with the document in at least ``match`` of their positions.

Edge cases: items of fewer tokens than ``window`` get masks of their own length's patterns; items
under ``min_tokens`` tokens are no evidence and match nothing; null or empty texts match nothing.
Rows without a doc_id are not judged (and are kept). Rows that repeat a doc_id are judged together. Very long
texts are judged whole. Empty tables, of documents or items, give no leak. Extra columns, whatever their
names, are ignored, or passed through by ``survivors``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked


@dataclass(frozen=True)
class Params:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 3, 6, 7, 9), (0, 2, 3, 6, 8, 9), (0, 1, 2, 5, 6, 8))
    window: int = 13
    match: float = 0.8
    min_tokens: int = 5
    broadcast_hashes: int = 500_000


def survivors_of(mask: tuple[int, ...], n: int, patterns: list[tuple[int, ...]]) -> set[int]:
    """The numbers of the substitution patterns that leave ``mask`` whole at some position of ``n`` tokens."""
    used = [{start + o for o in mask} for start in range(n - mask[-1])]
    return {i for i, lost in enumerate(patterns) if any(u.isdisjoint(lost) for u in used)}


@cache
def placed_masks(p: Params, lengths: tuple[int, ...]) -> dict[tuple[int, ...], tuple[int, ...]]:
    """Per mask, the window lengths whose items it seeds: ``p.masks`` where they fit, and greedily chosen
    masks until no allowed pattern of substitutions is without a seed. Longer lengths choose first."""
    weight = min(len(m) for m in p.masks)
    placed: dict[tuple[int, ...], list[int]] = {m: [] for m in p.masks}
    for n in sorted(lengths, reverse=True):
        lost = n - ceil(n * p.match)
        if comb(n, lost) > 5000:
            raise ValueError(f"too many patterns of {lost} substitutions in {n} tokens to seed them all")
        patterns = list(combinations(range(n), lost))
        w = min(weight, n - lost)
        left = set(range(len(patterns)))
        for m in placed:
            if m[-1] < n and len(m) >= w:
                placed[m].append(n)
                left -= survivors_of(m, n, patterns)
        shapes = {m: survivors_of(m, n, patterns) for m in ((0, *rest) for rest in combinations(range(1, n), w - 1))} if left else {}
        while left:
            best = max(shapes, key=lambda m: len(shapes[m] & left))
            placed[best] = [n]
            left -= shapes[best]
    return {m: tuple(ns) for m, ns in placed.items() if ns}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masked(rows: DataFrame, masks: list[tuple[int, ...]], wanted: list[Column] | None = None) -> DataFrame:
    """``rows`` has key columns and ``tokens``; returns the keys, pos and hash of every mask position,
    of each mask only in the rows where its column of ``wanted`` holds.

    The token hashes are shifted against themselves and zipped, so one explode yields each window as
    plain columns and the hashing runs in generated code.
    """
    keys = [c for c in rows.columns if c != "tokens"]
    used = sorted({o for m in masks for o in m})
    hashed = rows.select(*keys, F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    none = F.array().cast("array<bigint>")
    shifted = [F.col("h") if o == 0 else F.when(F.size("h") > o, F.slice("h", o + 1, F.greatest(F.size("h") - o, F.lit(0)))).otherwise(none) for o in used]
    # the outer explode keeps the optimizer from testing the zipped array's size by building it once more
    zipped = hashed.select(*keys, F.arrays_zip(*[c.alias(f"t{o}") for o, c in zip(used, shifted, strict=True)]).alias("z")).select(*keys, F.posexplode_outer("z").alias("pos", "w"))
    wanted = wanted or [F.lit(True)] * len(masks)
    hashes = [F.when(wanted[i] & F.col(f"w.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"w.t{o}") for o in m])) for i, m in enumerate(masks)]
    return zipped.select(*keys, "pos", F.explode_outer(F.array(*hashes)).alias("hash")).filter("hash is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """One row per (doc_id, item_id) that leaks: the best alignment's document offset, item length,
    tokens that agree, and the agreement of its best window."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items = scratch.keep(benchmark.filter("item_id is not null").select("item_id", tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") >= p.min_tokens).distinct(), "items")
    judged = F.least(F.size("tokens"), F.lit(p.window)).alias("n")
    lengths = tuple(sorted(r["n"] for r in items.select(judged).distinct().collect()))  # at most window values
    placed = placed_masks(p, lengths)
    masks = list(placed) or list(p.masks)
    wanted = [F.col("n").isin(*placed.get(m, ())) for m in masks]
    seeds = scratch.keep(masked(items.select("item_id", judged, "tokens"), masks, wanted).select("hash", "item_id", F.col("pos").alias("item_pos")), "seeds")
    seeds = checked(seeds, limit=p.broadcast_hashes)
    rows = docs.filter("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("tokens"))
    hits = masked(rows, masks).join(seeds, "hash").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = scratch.keep(hits, "hits")
    n_hits = hits.count()
    found = hits.select("doc_id").distinct()
    candidates = docs.select("doc_id", "text").join(checked(found, n_hits), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("doc"))
    candidates = scratch.keep(candidates, "candidates")  # else a document is split again at each of its diagonals
    met = candidates.join(checked(hits, n_hits), "doc_id").join(checked(items), "item_id")
    # a row keeps the tokens under the item, never the document's: a document of one repeated token has as many
    # diagonals as tokens. The explode of one element stops the optimizer from moving the cut into later uses.
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    under = F.slice("doc", begin + 1, F.size("tokens") - (begin - F.col("diagonal")))
    aligned = met.select("doc_id", "item_id", "diagonal", "tokens", F.explode_outer(F.array(under)).alias("under"))
    at = F.lit(1) + F.least(F.col("diagonal"), F.lit(0))
    agree = F.transform("tokens", lambda t, j: F.when(F.try_element_at("under", F.when(at + j >= 1, at + j).otherwise(F.size("under") + 1)) == t, 1).otherwise(0))
    n = F.size("tokens")
    w = F.least(n, F.lit(p.window))
    starts = F.sequence(F.lit(0), n - w)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(starts, lambda i: total(F.slice("agree", i + 1, w))))
    scored = (
        aligned.withColumn("agree", agree)
        .select("doc_id", "item_id", "diagonal", n.alias("item_tokens"), total(F.col("agree")).alias("matched"), best.alias("best"), w.alias("w"))
        .filter(F.col("best") >= F.ceil(F.col("w") * p.match))
    )
    top = F.max(F.struct("best", "matched", (-F.col("diagonal")).alias("d"), "item_tokens", "w"))
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(top.alias("top"))
        .select("doc_id", "item_id", (-F.col("top.d")).cast("long").alias("doc_offset"), F.col("top.item_tokens").cast("long").alias("item_tokens"), F.col("top.matched").cast("long").alias("matched_tokens"), F.round(F.col("top.best") / F.col("top.w"), 6).alias("best_window"))
    )


def survivors(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    bad = scratch.keep(leaks(docs, benchmark, p, scratch).select("doc_id").distinct(), "leaking")
    return docs.join(checked(bad), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
