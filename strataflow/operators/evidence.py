"""Ranked evidence: impact, traversal groups, shared contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.sizes import small

from . import relations as R
from .rank import evidence_score
from .traverse import oriented, reach


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int, relations: list[str] | None = None) -> DataFrame:
    """Nodes that a change reaches against the edges: node_id, distance, relation, score.

    The relation is that of the first edge by (distance, reached-from node, edge key).
    """
    relations = relations or R.impact()
    levels = reach(nodes, edges, starts, "incoming", relations, max_depth)
    hops = oriented(edges, "incoming", relations)
    far = levels.select(F.col("node_id").alias("from_id"), F.col("distance").alias("from_distance"))
    first = (
        hops.join(small(levels.filter("distance > 0")), F.col("node_id") == F.col("to_id")).join(small(far), "from_id").filter("from_distance = distance - 1")
        .groupBy("node_id", "distance").agg(F.min(F.struct("from_id", "source_id", "target_id", "relation")).alias("k"))
    )
    return first.select("node_id", "distance", F.col("k.relation").alias("relation"), (R.impact_weight(F.col("k.relation")) / F.col("distance")).alias("score"))


def traversal_groups(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str, relations: list[str], allowed: list[str], max_depth: int, seed_relevance: float = 1.0, confidence: float = 1.0) -> DataFrame:
    """Discovering edges grouped by (distance, relation): edge count and product score."""
    levels = reach(nodes, edges, starts, direction, relations, max_depth)
    hops = oriented(edges, direction, relations)
    far = levels.select(F.col("node_id").alias("from_id"), F.col("distance").alias("from_distance"))
    found = (
        hops.join(small(levels.filter("distance > 0")), F.col("node_id") == F.col("to_id")).join(small(far), "from_id").filter("from_distance = distance - 1")
        .groupBy("node_id", "distance").agg(F.min(F.struct("from_id", "source_id", "target_id", "relation")).alias("k"))
    )
    grouped = found.groupBy("distance", F.col("k.relation").alias("relation")).agg(F.count("*").alias("edges"))
    one = F.lit(1.0)
    score = evidence_score(F.lit(seed_relevance), F.col("distance"), R.fit(F.col("relation"), allowed), F.lit(confidence), one, F.col("edges"))
    return grouped.select("distance", "relation", "edges", score.alias("score"))


def suite_name(kind: Column, path: Column) -> Column:
    """The base name of a file that names both a contract and a test, else null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when((kind == "file") & name.contains("contract") & name.contains("test"), name)


def is_contract(kind: Column, path: Column) -> Column:
    k = F.lower(kind)
    return k.contains("interface") | k.contains("contract") | k.contains("test") | suite_name(kind, path).isNotNull()


def identity(kind: Column, qualified_name: Column, path: Column) -> Column:
    suite = suite_name(kind, path)
    return F.when(suite.isNotNull(), F.concat(F.lit("suite of "), suite)).when(is_contract(kind, path) & (qualified_name != ""), F.concat(F.lit("named "), F.lower(qualified_name)))


def common(nodes: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids in both sides' reach, or contract nodes that share a path or an identity across them.

    Each side is joined once; windows over the nodes in reach then tell what the other side has.
    """
    near = nodes.join(left.select("node_id", F.lit(True).alias("l")).distinct(), "node_id", "left").join(right.select("node_id", F.lit(True).alias("r")).distinct(), "node_id", "left").fillna(False, ["l", "r"]).filter("l or r")
    info = near.select("node_id", "l", "r", "span_path", is_contract(F.col("kind"), F.col("span_path")).alias("contract"), identity(F.col("kind"), F.col("qualified_name"), F.col("span_path")).alias("identity"))
    seen = lambda side, by: F.max((F.col(side) & F.col("contract")).cast("int")).over(Window.partitionBy(by)) == 1
    crossed = lambda by: (F.col("l") & seen("r", by)) | (F.col("r") & seen("l", by))
    flagged = info.withColumns({"by_path": F.col("contract") & (F.col("span_path") != "") & crossed("span_path"), "by_identity": F.col("identity").isNotNull() & crossed("identity")})
    return flagged.filter((F.col("l") & F.col("r")) | F.col("by_path") | F.col("by_identity")).select("node_id").distinct()
