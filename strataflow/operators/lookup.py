"""Exact and ranked node lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.text import identifier_tokens

ORDER = ("qualified_name", "label", "node_id")


def exact(nodes: DataFrame, term: str) -> DataFrame:
    """By id, qualified name, or a file's path; ordered, no limit."""
    hit = (F.col("node_id") == term) | (F.col("qualified_name") == term) | ((F.col("kind") == "file") & (F.col("span_path") == term))
    return nodes.filter(hit).orderBy(*ORDER)


def lookup_rank(term: str) -> Column:
    """0 id, 1 qualified name, 2 label, 3 beginning of label, name or a part of them, 4 in the path,
    5 anywhere; null if nothing fits. Letters are compared in lower case, the term literally."""
    t = term.lower()
    low = {c: F.lower(c) for c in ("node_id", "qualified_name", "label", "span_path")}
    part = "(?s).*[^a-z0-9]" + re.escape(t) + ".*"
    start = low["label"].startswith(t) | low["qualified_name"].startswith(t) | low["label"].rlike(part) | low["qualified_name"].rlike(part)
    return (
        F.when(F.col("node_id") == term, 0).when(F.col("qualified_name") == term, 1).when(low["label"] == t, 2).when(start, 3)
        .when(low["span_path"].contains(t), 4).when(low["node_id"].contains(t) | low["qualified_name"].contains(t) | low["label"].contains(t), 5)
    )


def ranked(nodes: DataFrame, term: str, limit: int, kinds: list[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` nodes for a term, optionally of some kinds and inside a project scope."""
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(kinds))
    if scope is not None:
        nodes = nodes.join(scope.select("node_id"), "node_id", "left_semi")
    return nodes.withColumn("rank", lookup_rank(term)).filter("rank is not null").orderBy("rank", *ORDER).limit(limit)


def term_rank(term: Column) -> Column:
    """Rules of the in-memory ranking: labels case-sensitively, beginnings of identifier parts."""
    t = F.lower(term)
    parts = F.array_union(identifier_tokens(F.col("label")), identifier_tokens(F.col("qualified_name")))
    return (
        F.when(F.col("node_id") == term, 0).when(F.col("qualified_name") == term, 1).when(F.col("label") == term, 2)
        .when(F.lower("label").startswith(t) | F.exists(parts, lambda p: p.startswith(t)), 3)
        .when(F.lower("span_path").contains(t), 4).when(F.lower("node_id").contains(t) | F.lower("qualified_name").contains(t) | F.lower("label").contains(t), 5)
    )


def rank_terms(nodes: DataFrame, terms: list[str], top: int = 3) -> DataFrame:
    """The ``top`` distinct nodes of each term: term, position, node_id, rank.

    Each term keeps only its best rows before they meet, so nothing but ``top`` rows per term moves.
    """
    out = None
    for term in terms:
        best = nodes.withColumn("rank", term_rank(F.lit(term))).filter("rank is not null").groupBy("node_id", "qualified_name", "label").agg(F.min("rank").alias("rank")).orderBy("rank", *ORDER).limit(top).withColumn("term", F.lit(term))
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy("term").orderBy("rank", *ORDER)
    return out.select("term", F.row_number().over(w).alias("position"), "node_id", "rank")


def resolve(nodes: DataFrame, term: str, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """Exact matches if there are any, else the best ranked ones, optionally inside a project scope."""
    if scope is not None:
        nodes = nodes.join(scope.select("node_id"), "node_id", "left_semi")
    found = exact(nodes, term).limit(limit)
    return found.withColumn("rank", lookup_rank(term)) if not found.isEmpty() else ranked(nodes, term, limit)


def resolved_ids(nodes: DataFrame, term: str, limit: int, scope: DataFrame | None = None) -> list[str]:
    """The ids of ``resolve``, at most ``limit``, in one job."""
    if scope is not None:
        nodes = nodes.join(scope.select("node_id"), "node_id", "left_semi")
    hit = (F.col("node_id") == term) | (F.col("qualified_name") == term) | ((F.col("kind") == "file") & (F.col("span_path") == term))
    near = nodes.withColumn("_exact", F.coalesce(hit, F.lit(False))).withColumn("_rank", F.when(F.col("_exact"), F.lit(-1)).otherwise(lookup_rank(term))).filter("_rank is not null")
    some = near.orderBy("_rank", *ORDER).limit(limit).select("node_id", "_exact").collect()
    return [r["node_id"] for r in some if r["_exact"] == some[0]["_exact"]]
