"""Catalog of code units: synopses, reuse, embeddings, search and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.text import CATALOG, bm25, identifier_tokens, match_groups, plain_tokens
from strataflow.functions.vectors import cosine, l2

from .incremental import latest_wins

SYNOPSIS_LIMIT = 300
LEXICAL_LIMIT, RESULT_LIMIT = 50, 10
#: Weights of catalog search fields (fixed values).
WEIGHTS = {"name": 8.0, "synopsis": 5.0, "other": 1.0}


def synopsis(name: Column, owner: Column, kind: Column, comments: Column, signature: Column, tokens: Column) -> Column:
    """``Owner.Name (kind). comments Signature: s. Identifiers: t`` within a length limit."""
    head = F.concat(F.when(owner != "", F.concat(owner, F.lit("."))).otherwise(""), name, F.lit(" ("), F.element_at(F.split(kind, ":"), -1), F.lit(")."))
    parts = F.concat_ws(" ", head, F.when(F.size(comments) > 0, F.array_join(comments, " ")), F.when(signature != "", F.concat(F.lit("Signature: "), signature, F.lit("."))), F.when(F.size(tokens) > 0, F.concat(F.lit("Identifiers: "), F.array_join(tokens, " "))))
    return F.substring(parts, 1, SYNOPSIS_LIMIT)


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def unit_tokens(name: Column) -> Column:
    return identifier_tokens(name, CATALOG)


def signature(source: Column) -> Column:
    """The text before the first brace."""
    return F.trim(F.substring_index(source, "{", 1))


def reuse(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Units with the stored synopsis where name, fingerprint and deterministic synopsis are unchanged."""
    old = stored.select("node_id", F.col("name").alias("o_name"), F.col("fingerprint").alias("o_print"), F.col("synopsis").alias("o_synopsis"), F.col("written").alias("o_written"))
    same = (F.col("name") == F.col("o_name")) & (F.col("fingerprint") == F.col("o_print")) & (F.col("synopsis") == F.col("o_synopsis"))
    joined = fresh.join(old, "node_id", "left")
    return joined.select("node_id", "name", "fingerprint", "synopsis", F.when(same, F.col("o_written")).alias("written"), F.coalesce(same, F.lit(False)).alias("reused"))


def missing_embeddings(entries: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    return entries.join(vectors.select(key).distinct(), key, "left_anti")


def embed(entries: DataFrame, text: str, model) -> DataFrame:
    """Add a vector column with a plug-in that maps a pandas Series of texts to lists of floats, in Arrow batches."""
    return entries.withColumn("vector", F.pandas_udf(model, "array<float>")(F.col(text)))


def copy_catalog(entries: DataFrame, visible: DataFrame) -> DataFrame:
    return entries.join(visible.select("node_id").distinct(), "node_id", "left_semi")


def search(entries: DataFrame, text: str, limit: int | None = LEXICAL_LIMIT) -> DataFrame:
    """Catalog entries by BM25 over prefix terms, any of which may match; None as limit gives all. Besides the name
    and the deterministic synopsis every column ``synopsis_<provider>`` is a field of weight 1."""
    terms = match_groups(text, [], [])
    fields = {"name": plain_tokens(F.col("name")), "synopsis": plain_tokens(F.col("synopsis"))} | {c: plain_tokens(F.col(c)) for c in entries.columns if c.startswith("synopsis_")}
    found = bm25(entries, "node_id", fields, {c: WEIGHTS.get(c, WEIGHTS["other"]) for c in fields}, terms)
    hits = found.join(entries.select("node_id", "name"), "node_id")
    return hits if limit is None else hits.orderBy(F.desc("score"), "name", "node_id").limit(limit)


def min_distances(vectors: DataFrame, query: list[float], digits: int | None = None) -> DataFrame:
    """(node_id, distance): the smallest distance of any of a node's vectors of the query's dimension."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    least = F.min(l2(F.col("vector"), q))
    return vectors.filter(F.size("vector") == len(query)).groupBy("node_id").agg((F.round(least, digits) if digits is not None else least).alias("distance"))


def nearest(vectors: DataFrame, query: list[float], limit: int, digits: int | None = None) -> DataFrame:
    """The nodes with the smallest distances; ``digits`` rounds them before they are compared."""
    return min_distances(vectors, query, digits).orderBy("distance", "node_id").limit(limit)


def rerank(lexical: DataFrame, vectors: DataFrame, query: list[float], limit: int = RESULT_LIMIT) -> DataFrame:
    """Lexical hits (node_id, position) by the best cosine of their vectors; unscored ones last, in order."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    best = vectors.join(lexical.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.max(cosine(F.col("vector"), q)).alias("similarity"))
    return lexical.join(best, "node_id", "left").orderBy(F.col("similarity").isNull(), F.desc("similarity"), "position").limit(limit)


def ranked(entries: DataFrame, vectors: DataFrame | None, text: str, embed: Callable[[str], list[float]] | None = None) -> dict:
    """Lexical hits, re-ranked by their vectors if a model is there; without a lexical hit the nearest vectors.

    Returns matches (node_id, name; at most ``RESULT_LIMIT``), the method, why embeddings were not used, and
    warnings. Everything on the driver is bounded by ``LEXICAL_LIMIT``.
    """
    if not text.strip():
        raise ValueError("rank catalog: a text is needed")
    found = search(entries, text).select("node_id", "name", "score").collect()
    out = {"matches": [{"node_id": r["node_id"], "name": r["name"], "score": r["score"]} for r in found], "method": "lexical", "skipped": "no embedding model is set", "warnings": []}
    query = None
    if embed is not None and vectors is not None:
        try:
            query, out["skipped"] = list(embed(text)), ""
        except Exception as e:  # noqa: BLE001  a model is outside code; the lexical answer stands without it
            out["skipped"] = f"the embedding model failed: {e}"
    if not found:
        near = nearest(vectors, query, LEXICAL_LIMIT).join(entries.select("node_id", "name"), "node_id").orderBy("distance", "node_id").limit(RESULT_LIMIT).collect() if query else []
        if near:
            return out | {"matches": [{"node_id": r["node_id"], "name": r["name"], "score": -r["distance"]} for r in near], "method": "embeddings"}
        out["skipped"] = out["skipped"] or "no vector is near"
        out["warnings"] = ["no unit of the catalog fits"]
        return out
    if query:
        spark = entries.sparkSession
        at = spark.createDataFrame([(m["node_id"], i) for i, m in enumerate(out["matches"])], "node_id string, position int")
        order = rerank(at, vectors, query, LEXICAL_LIMIT).collect()
        if any(r["similarity"] is not None for r in order):
            out["matches"] = [out["matches"][r["position"]] | {"similarity": r["similarity"]} for r in order]
            out["method"] = "lexical_and_embeddings"
        else:
            out["skipped"] = "none of the hits has a vector that fits"
    out["matches"] = out["matches"][:RESULT_LIMIT]
    return out


def with_position(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def read(entries: DataFrame, vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries of some node ids with their vectors (a row for each origin; null without one)."""
    return entries.join(ids.select("node_id").distinct(), "node_id", "left_semi").join(vectors, "node_id", "left")


def delete(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The entries without those of some node ids."""
    return entries.join(gone.select("node_id"), "node_id", "left_anti")


def write_vectors(log: DataFrame, most_dims: int = 8192) -> DataFrame:
    """The last vector of each node and origin in an append log (seq); ones of impossible size are refused."""
    return latest_wins(log.filter(F.size("vector").between(1, most_dims)), ["node_id", "origin"], ["seq"])
