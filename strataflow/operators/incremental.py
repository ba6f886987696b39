"""Dependency-driven invalidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_targets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rewritten source paths whose exported surfaces (source_path, node_id, name) differ, or are new."""
    columns = ["source_path", "node_id", "name"]
    scope = after.select("source_path").distinct()
    was = before.select(columns).distinct().join(scope, "source_path", "left_semi")
    now = after.select(columns).distinct()
    differ = was.exceptAll(now).union(now.exceptAll(was)).select("source_path")
    new = scope.join(before.select("source_path").distinct(), "source_path", "left_anti")
    return differ.union(new).distinct()


def affected(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Sources one hop away that depend on a changed target, without the changed ones themselves."""
    hit = dependencies.join(changed.select(F.col("source_path").alias("target_path")), "target_path", "left_semi").select("source_path").distinct()
    return hit.join(changed.select("source_path"), "source_path", "left_anti")


def derive_dependencies(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """File-to-file dependencies of resolved edges between different paths."""
    s = owners.select(F.col("node_id").alias("source_id"), F.col("span_path").alias("source_path"))
    t = owners.select(F.col("node_id").alias("target_id"), F.col("span_path").alias("target_path"))
    return edges.join(s, "source_id").join(t, "target_id").filter("source_path <> target_path").select("source_path", "target_path").distinct()


def close_prior(writes: DataFrame) -> DataFrame:
    """Validity intervals of append-only writes: each ends just before its source's next one."""
    from pyspark.sql import Window

    following = F.lead("valid_from").over(Window.partitionBy("source_path").orderBy("valid_from"))
    return writes.withColumn("valid_to", following - 1)


def missing_sources(known: DataFrame, staged: DataFrame) -> DataFrame:
    """Sources that a full index no longer found: they get a tombstone."""
    return known.select("source_path").distinct().join(staged.select("source_path"), "source_path", "left_anti")


def retain(edges: DataFrame, previous: int, replaced: DataFrame) -> DataFrame:
    """The previous version's workspace edges whose owner is not replaced."""
    return edges.filter(F.col("version") == previous).join(replaced.select(F.col("source_path").alias("owner")), "owner", "left_anti")


def rebase(rows: DataFrame, boundary: int) -> DataFrame:
    """Rows that are still visible at or after the boundary, beginning there at the earliest."""
    return rows.filter(F.col("valid_to").isNull() | (F.col("valid_to") >= boundary)).withColumn("valid_from", F.greatest("valid_from", F.lit(boundary)))


def rollback(rows: DataFrame, version: int) -> DataFrame:
    """The rows as they were at ``version``: newer ones go, and what they had closed is open again."""
    return rows.filter(F.col("valid_from") <= version).withColumn("valid_to", F.when(F.col("valid_to") < version, F.col("valid_to")))


def latest_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append log (an upsert)."""
    payload = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("r"))
    return last.select(*key, "r.*")


def first_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (an insert that ignores conflicts)."""
    payload = [c for c in log.columns if c not in key]
    first = log.groupBy(*key).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("r"))
    return first.select(*key, "r.*")


def duplicate_sources(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("source_path").agg(F.count("*").alias("n")).filter("n > 1")


def tombstones(contributions: DataFrame, gone: DataFrame, version: int) -> DataFrame:
    """Empty contributions of removed sources: source_path, the version that closes them, and no facts."""
    known = contributions.select("source_path").distinct().join(gone.select("source_path"), "source_path", "left_semi")
    return known.select("source_path", F.lit(version).alias("valid_from"), F.lit(0).alias("facts"))
