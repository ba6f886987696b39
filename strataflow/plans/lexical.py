"""The lexical index of a version: postings that are sorted by token, and totals.

In a store the index is log-structured. A publish writes one immutable segment with the postings and the totals of
the sources that it replaces, and nothing else; the store masks what older segments hold of these sources, adds the
totals of what is left, and merges segments when many have come together. There every node row is a document of its
own, and a node that several sources contribute has the score of its best row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.text import B, K1, folded, idf, saturated

#: Names of the two workspace tables in a store.
POSTINGS, TOTALS = "lexical_postings", "lexical_totals"


def by_token(rows: DataFrame, keys: list[str], fields: Sequence[str]) -> DataFrame:
    """(token, keys, hits) of rows whose columns ``fields`` are token arrays: a row's places sorted by token and cut
    where the token changes, so places are grouped inside their row and not shuffled."""

    def places(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda t, i: F.struct(t.alias("token"), F.lit(name).alias("field"), i.alias("pos")))

    def alone(df: DataFrame, *columns: Column) -> DataFrame:
        """With more columns, computed once: an outer explode of one element keeps them from being copied into later uses."""
        return df.select("*", F.explode_outer(F.array(F.struct(*columns))).alias("_c")).select(*df.columns, "_c.*")

    def token(i: Column) -> Column:
        return F.get(F.col("_s"), i)["token"]

    every = alone(rows.select(*keys, *fields), F.array_sort(F.concat(*[places(n) for n in fields])).alias("_s")).select(*keys, "_s").filter(F.size("_s") > 0)
    heads = alone(every, F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (token(i) != token(i - 1))).alias("_at"))
    one = heads.select(*keys, "_s", "_at", F.posexplode("_at").alias("_n", "_i"))
    size = F.coalesce(F.get(F.col("_at"), F.col("_n") + 1), F.size("_s")) - F.col("_i")
    hits = F.transform(F.slice("_s", F.col("_i") + 1, size), lambda x: F.struct(x["field"].alias("field"), x["pos"].alias("pos")))
    return one.select(token(F.col("_i")).alias("token"), *keys, hits.alias("hits"))


def segment(nodes: DataFrame, fields: dict[str, Column], key: str = "node_id") -> dict[str, DataFrame]:
    """The two tables of a segment: postings (token, node_id, size, hits, source_path), each file sorted by token, and
    totals per source (source_path, documents, tokens). Postings stay in the task that made them; a merge orders them
    over all files."""
    size = sum((F.size(c) for c in fields.values()), F.lit(0))
    at = F.monotonically_increasing_id()  # tells the rows of one node apart
    arrays = nodes.select(F.col(key).alias("node_id"), "source_path", at.alias("row"), size.alias("size"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("f")).select("node_id", "source_path", "row", "size", "f.*")
    rows = by_token(arrays, ["node_id", "source_path", "row", "size"], list(fields))
    totals = nodes.select("source_path", size.alias("size")).groupBy("source_path").agg(F.count("*").alias("documents"), F.sum("size").cast("long").alias("tokens"))
    return {POSTINGS: rows.sortWithinPartitions("token", "node_id"), TOTALS: totals}


class LexicalIndex:
    """BM25 from stored postings: a search reads only the tokens that begin with one of its terms.

    ``rows`` (token, node_id, size, hits: one struct of field and positions each) are range-partitioned and
    sorted by token, so a prefix is a range that Parquet's statistics prune; ``totals`` is one row (documents,
    average size).
    """

    def __init__(self, rows: DataFrame, totals: DataFrame):
        self.rows, self.totals = rows, totals

    @classmethod
    def stored(cls, store, version: int) -> LexicalIndex:
        """The index of a stored version: its segments' live postings, and the sum of their live totals."""
        totals = store.workspace(TOTALS, version).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens") / F.sum("documents"), F.lit(0.0)).alias("average"))
        return cls(store.workspace(POSTINGS, version), totals)

    @classmethod
    def build(cls, nodes: DataFrame, fields: dict[str, Column], key: str = "node_id") -> LexicalIndex:
        """Tokenise every node once. Of a node with several rows the least one, by its fields, is indexed."""
        size = sum((F.size(c) for c in fields.values()), F.lit(0))
        arrays = nodes.select(F.col(key).alias("node_id"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("f"), size.alias("size"))
        once = arrays.groupBy("node_id").agg(F.min(F.struct("f", "size")).alias("m")).select("node_id", F.col("m.size").alias("size"), "m.f.*")
        rows = by_token(once, ["node_id", "size"], list(fields))
        totals = once.agg(F.count("*").alias("documents"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("average"))
        return cls(rows.repartitionByRange("token").sortWithinPartitions("token", "node_id"), totals)

    def search(self, weights: dict[str, float], groups: list[list[str]], phrases: Sequence[str] = ()) -> DataFrame:
        """(node_id, score), as ``functions.text.bm25`` over the same nodes."""
        prefixes = [(g, folded(t)) for g, terms in enumerate(groups) for t in terms]
        quoted = [w for p in phrases if (w := [folded(x) for x in p.split()])]
        # a prefix is a range of tokens: both ends are plain comparisons that reach the scan
        ranges = [F.col("token").between(t, t + "\U0010ffff") & F.col("token").startswith(t) for _, t in prefixes] + [F.col("token") == w for p in quoted for w in p]
        if not ranges:
            return self.rows.limit(0).select("node_id", F.lit(0.0).alias("score"))
        wanted = ranges[0]
        for r in ranges[1:]:
            wanted = wanted | r
        near = self.rows.filter(wanted)
        weight = F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))])

        def weighed(places: Column) -> Column:
            return F.aggregate(places, F.lit(0.0), lambda total, h: total + F.coalesce(F.try_element_at(weight, h["field"]), F.lit(0.0)))

        def shifted(word: str, by: int) -> Column:
            """Where a phrase would begin for its word number ``by`` to be here."""
            return F.flatten(F.collect_list(F.when(F.col("token") == word, F.transform("hits", lambda h: F.struct(h["field"].alias("field"), (h["pos"] - by).alias("pos"))))))

        def both(places: Column, more: Column) -> Column:
            return F.filter(places, lambda x: F.array_contains(more, x))

        hits = [F.sum(F.when(F.col("token").startswith(t), weighed(F.col("hits"))).otherwise(0.0)).alias(f"h{i}") for i, (_, t) in enumerate(prefixes)]
        places = [shifted(w, j).alias(f"p{i}_{j}") for i, p in enumerate(quoted) for j, w in enumerate(p)]
        document = [c for c in ("node_id", "source_path", "row", "size") if c in self.rows.columns]
        per = near.groupBy(*document).agg(*hits, *places)
        for i, p in enumerate(quoted):
            starts = F.col(f"p{i}_0")
            for j in range(1, len(p)):
                starts = both(starts, F.col(f"p{i}_{j}"))
            per = per.withColumn(f"h{len(prefixes) + i}", weighed(starts))
        n = len(prefixes) + len(quoted)
        totals = self.totals.crossJoin(per.agg(*[F.coalesce(F.sum((F.col(f"h{i}") > 0).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in range(n)]))  # one row each
        true = [F.lit(True)] * len(groups)
        for i, (g, _) in enumerate(prefixes):
            true[g] = true[g] & (F.col(f"h{i}") > 0)
        matched, score = F.lit(False), F.lit(0.0)
        for i in range(n):
            applies = true[prefixes[i][0]] if i < len(prefixes) else F.col(f"h{i}") > 0
            matched = matched | applies
            score = score + idf(F.col("documents"), F.col(f"n{i}")) * saturated(F.when(applies, F.col(f"h{i}")).otherwise(0.0), F.col("size"), F.col("average"), K1, B)
        found = per.crossJoin(F.broadcast(totals)).filter(matched).select("node_id", score.alias("score"))
        return found.groupBy("node_id").agg(F.max("score").alias("score")) if "source_path" in document else found
