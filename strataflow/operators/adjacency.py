"""Edges by node: a stored table in which a hop reads the rows of its frontier and skips the rest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.lineage import checkpoint_dir, cut
from strataflow.functions.sizes import small

from .traverse import EDGE_KEY, those_among

ORDER = ("from_id", "direction")
DIRECTIONS = {"outgoing": ("out", "loop"), "incoming": ("in", "loop"), "both": ("out", "in", "loop")}
#: Most rows of a page: small ones leave less to read around the few rows of a frontier.
PAGE_ROWS = 1_000
#: The columns that ``Adjacency.build`` writes; the edge's ends follow from them.
LAID = ("from_id", "direction", "to_id", "relation")


def both_ways(edges: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(from_id, direction, to_id, edge key, extra): every edge from each of its ends, ``out`` from its source; a
    self-loop once. The edges are computed once, each row giving both."""

    def end(start: str, direction: Column, to: str) -> Column:
        return F.struct(F.col(start).alias("from_id"), direction.alias("direction"), F.col(to).alias("to_id"))

    one = end("source_id", F.when(F.col("source_id") == F.col("target_id"), "loop").otherwise("out"), "target_id")
    two = F.array(end("source_id", F.lit("out"), "target_id"), end("target_id", F.lit("in"), "source_id"))
    ends = F.explode(F.when(F.col("source_id") != F.col("target_id"), two).otherwise(F.array(one)))
    return edges.select(ends.alias("_end"), *EDGE_KEY, *extra).select("_end.*", *EDGE_KEY, *extra)


def laid_out(rows: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by the node that a hop starts from."""
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def any_of(column: str, values: Sequence[Column]) -> Column:
    """Whether a column has one of the values, as a balanced tree of equalities: of a long list Spark hands only the
    least and the greatest value to Parquet, of equalities each."""
    some = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(some) > 1:
        some = [a | b for a, b in zip(some[::2], some[1::2])] + some[len(some) & ~1 :]
    return some[0]


class Adjacency:
    """Rows of ``both_ways``, and the ``ids`` (node_id) of all nodes if edges may end elsewhere.

    Rows are sorted by ``from_id``, or by ``from_key``, a hash of it, where they have one. Row groups and pages hold
    ranges of that column, so a filter by a frontier is decided by their minima and maxima: what a hop reads follows its
    frontier, not the number of edges. A stored table holds edges between existing nodes only and has no ``ids``.
    """

    def __init__(self, rows: DataFrame, ids: DataFrame | None = None):
        self.rows, self.ids = rows, ids

    @property
    def whole(self) -> bool:
        """Whether every edge is known to end in existing nodes."""
        return self.ids is None

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, path: str | None = None) -> Adjacency:
        """Write the table, by default to the checkpoint folder, and read it back.

        Every task sorts and writes the edges that it has: nothing is exchanged or joined for the layout, and each file
        has its own order, by a number, as ids often begin alike. Which ends exist is tested where a hop meets them, against the node ids beside the table.
        """
        spark = edges.sparkSession
        path = path or f"{checkpoint_dir(spark)}/adjacency-{uuid.uuid4().hex[:12]}"
        both_ways(edges).select(F.xxhash64("from_id").alias("from_key"), *LAID).sortWithinPartitions("from_key").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
        nodes.select("node_id").write.parquet(f"{path}-ids")
        back = F.col("direction") == "in"
        source, target = F.when(back, F.col("to_id")).otherwise(F.col("from_id")), F.when(back, F.col("from_id")).otherwise(F.col("to_id"))
        rows = spark.read.parquet(path).select("from_key", "from_id", "direction", "to_id", source.alias("source_id"), target.alias("target_id"), "relation")
        return cls(rows, spark.read.parquet(f"{path}-ids"))

    def at(self, frontier: Sequence[str], direction: str, relations: Sequence[str] | None = None) -> DataFrame:
        """The edges from the nodes of a frontier, wherever they end."""
        found = self.rows.filter(F.col("from_id").isin(list(frontier)) & F.col("direction").isin(*DIRECTIONS[direction]))
        if "from_key" in found.columns:
            found = found.filter(any_of("from_key", [F.xxhash64(F.lit(n)) for n in frontier])).drop("from_key")
        return found.filter(F.col("relation").isin(list(relations))) if relations else found

    def near(self, frontier: Sequence[str], direction: str, relations: Sequence[str] | None = None) -> DataFrame:
        """The edges to travel from the nodes of a frontier: those that end in existing nodes."""
        found = self.at(frontier, direction, relations)
        if self.whole:
            return found
        found = cut(found)
        there = cut(those_among(self.ids, found.select(F.col("to_id").alias("node_id"))))
        return found.join(small(there.withColumnRenamed("node_id", "to_id")), "to_id", "left_semi")

    def hops(self, direction: str, relations: Sequence[str] | None = None) -> DataFrame:
        """All edges in the direction of travel, wherever they end."""
        found = self.rows.filter(F.col("direction").isin(*DIRECTIONS[direction]))
        return found.filter(F.col("relation").isin(list(relations))) if relations else found
