"""Snapshot scans: which rows a graph version sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame) -> DataFrame:
    """The newest version as one row (no row if there is none)."""
    return versions.orderBy(F.desc("version")).limit(1)


def pinned(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked version: ``found``, ``pruned`` (below the oldest kept one) or ``version not found``."""
    oldest = versions.agg(F.min("version").alias("oldest"))
    known = versions.select("version", F.lit(True).alias("known"))
    status = F.when(F.col("known"), "found").when((F.col("version") > 0) & (F.col("version") < F.col("oldest")), "pruned").otherwise("version not found")
    return asked.select("version").join(known, "version", "left").crossJoin(F.broadcast(oldest)).select("version", status.alias("status"))  # one row of totals


def at(version: int) -> Column:
    """The temporal predicate; plain columns and a constant, so it reaches the Parquet scan."""
    return (F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") >= version))


def visible(contributed: DataFrame, workspace: DataFrame, version: int, columns: list[str]) -> DataFrame:
    """Contribution rows valid at ``version`` and that version's workspace rows, distinct over ``columns``."""
    return contributed.filter(at(version)).select(columns).unionByName(workspace.filter(F.col("version") == version).select(columns)).distinct()


def node_of(contributed: DataFrame, workspace: DataFrame, version: int) -> DataFrame:
    """One row per node id: the workspace row if there is one, else that of the last source path."""
    keep = ["node_id", "kind", "label", "qualified_name"]
    rows = contributed.filter(at(version)).select(*keep, F.col("source_path"), F.lit(0).alias("rank")).unionByName(workspace.filter(F.col("version") == version).select(*keep, F.lit("").alias("source_path"), F.lit(1).alias("rank")))
    order = Window.partitionBy("node_id").orderBy(F.desc("rank"), F.desc("source_path"), "kind", "label", "qualified_name")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select(*keep)


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges at either end of a node, in key order; two equality scans instead of one OR."""
    out, into = edges.filter(F.col("source_id") == node_id), edges.filter((F.col("target_id") == node_id) & (F.col("source_id") != node_id))
    return out.unionByName(into).orderBy("source_id", "target_id", "relation")


def fact_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct node ids and edge keys, as one row."""
    n = nodes.agg(F.countDistinct("node_id").alias("nodes"))
    e = edges.select("source_id", "target_id", "relation").distinct().agg(F.count("*").alias("edges"))
    return n.crossJoin(e)  # one row each


def source_contributions(contributed: DataFrame, edges: DataFrame, version: int) -> DataFrame:
    """Per source path: the sorted ids of its nodes and the keys of its edges.

    A source file's facts are bounded by the file, so gathering them in one row is bounded too.
    """
    n = contributed.filter(at(version)).groupBy("source_path").agg(F.sort_array(F.collect_set("node_id")).alias("nodes"))
    key = F.concat_ws("|", "source_id", "target_id", "relation")
    e = edges.filter(at(version)).groupBy("source_path").agg(F.sort_array(F.collect_set(key)).alias("edges"))
    return n.join(e, "source_path", "left").select("source_path", "nodes", F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def page(rows: DataFrame, key: str, after: str, limit: int) -> DataFrame:
    """Keyset page: the next ``limit`` rows whose key comes after ``after``."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(limit)


def uncovered(contributed: DataFrame, covered: DataFrame, version: int) -> DataFrame:
    """Visible source paths without a coverage row; none means the catalog is complete."""
    return contributed.filter(at(version)).select("source_path").distinct().join(covered.select("source_path"), "source_path", "left_anti")


def staged_view(visible_rows: DataFrame, staged: DataFrame, rewritten: DataFrame) -> DataFrame:
    """What a session sees before commit: staged rows in place of those of rewritten sources."""
    return visible_rows.join(rewritten.select("source_path"), "source_path", "left_anti").unionByName(staged)


def point_read(contributed: DataFrame, workspace: DataFrame, version: int, node_id: str) -> DataFrame:
    """``node_of`` one id: the id reaches both scans before anything is ranked."""
    mine = F.col("node_id") == node_id
    return node_of(contributed.filter(mine), workspace.filter(mine), version)


def resolver_projections(version: int, **tables: DataFrame) -> DataFrame:
    """Per source path the rows of each contribution table that it has at a version, as one array per table.

    What one file contributes is bounded by the file. ``tables`` have source_path and a validity interval.
    """
    out = None
    for name, df in tables.items():
        row = F.struct(*[c for c in df.columns if c not in ("source_path", "valid_from", "valid_to")])
        part = df.filter(at(version)).groupBy("source_path").agg(F.sort_array(F.collect_set(row)).alias(name))
        out = part if out is None else out.join(part, "source_path", "full")
    return out.select("source_path", *[F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in tables])


def resolver_target(version: int, source_path: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """The rows of one source path at a version, table by table."""
    return {name: df.filter(at(version) & (F.col("source_path") == source_path)).drop("valid_from", "valid_to") for name, df in tables.items()}


def package_page(files: DataFrame, directory: str, after: str = "", limit: int = 128, path: str = "span_path", key: str = "node_id") -> DataFrame:
    """Keyset page of the files that lie directly in a directory."""
    inside = F.regexp_replace(F.col(path), "/?[^/]*$", "") == directory
    return page(files.filter(inside), key, after, limit)


def retained(versions: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` versions, which are kept."""
    return versions.select("version").distinct().orderBy(F.desc("version")).limit(most)


def publish_totals(rows: DataFrame) -> DataFrame:
    """(version, sources, nodes) that each version wrote: from its contribution rows (source_path, valid_from)."""
    return rows.groupBy(F.col("valid_from").alias("version")).agg(F.countDistinct("source_path").alias("sources"), F.count("*").alias("nodes"))
