"""Exports of a snapshot's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfiltered_edges(contributed: DataFrame, workspace: DataFrame, version: int) -> DataFrame:
    """One row per edge key: the workspace row's owner if there is one, else the last source path."""
    from .snapshot import at

    keys = ["source_id", "target_id", "relation"]
    rows = contributed.filter(at(version)).select(*keys, F.struct(F.lit(0).alias("rank"), F.col("source_path").alias("owner")).alias("o")).unionByName(workspace.filter(F.col("version") == version).select(*keys, F.struct(F.lit(1).alias("rank"), F.col("owner")).alias("o")))
    return rows.groupBy(*keys).agg(F.max("o").alias("o")).select(*keys, F.col("o.owner").alias("owner"))


def filtered(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None, relations: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Nodes of some kinds, and edges of some relations whose two ends are both exported."""
    n = nodes.filter(F.col("kind").isin(kinds)) if kinds else nodes
    e = edges.filter(F.col("relation").isin(relations)) if relations else edges
    ids = n.select("node_id").distinct()
    return n, e.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def checksum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free checksum: no global sort, partial sums only."""
    line = F.concat_ws("\t", *columns)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("checksum"))
