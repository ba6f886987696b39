"""Graph tables derived from the star-schema tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "g_place": "SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS n_path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "g_nodes": """SELECT 'project:' || r_name AS node_id, 'project' AS kind, r_name AS label, r_name AS qualified_name, r_name AS span_path FROM region
        UNION ALL SELECT 'file:' || n_nationkey, 'file', n_name, n_path, n_path FROM g_place
        UNION ALL SELECT 'class:' || c_custkey, 'typescript:class', c_name, n_name || '::' || c_name, n_path FROM customer JOIN g_place ON c_nationkey = n_nationkey
        UNION ALL SELECT 'interface:' || s_suppkey, 'typescript:interface', s_name, n_name || '::' || s_name, n_path FROM supplier JOIN g_place ON s_nationkey = n_nationkey
        UNION ALL SELECT 'method:' || o_orderkey, 'typescript:method', o_orderpriority, c_name || '.' || o_orderkey, n_path FROM orders JOIN customer ON o_custkey = c_custkey JOIN g_place ON c_nationkey = n_nationkey
        UNION ALL SELECT 'function:' || p_partkey, 'typescript:function', p_name, p_brand || '::' || p_name, p_type FROM part""",
    "g_edges": """SELECT 'project:' || r_name AS source_id, 'file:' || n_nationkey AS target_id, 'contains' AS relation FROM g_place
        UNION ALL SELECT 'file:' || c_nationkey, 'class:' || c_custkey, 'defines' FROM customer
        UNION ALL SELECT 'file:' || s_nationkey, 'interface:' || s_suppkey, 'defines' FROM supplier
        UNION ALL SELECT 'class:' || o_custkey, 'method:' || o_orderkey, 'calls' FROM orders
        UNION ALL SELECT DISTINCT 'method:' || l_orderkey, 'function:' || l_partkey, 'references' FROM lineitem
        UNION ALL SELECT DISTINCT 'interface:' || l_suppkey, 'function:' || l_partkey, 'implements' FROM lineitem
        UNION ALL SELECT DISTINCT 'file:' || c_nationkey, 'file:' || s_nationkey, 'imports_from' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_orders": "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate, year(o_orderdate) * 4 + quarter(o_orderdate) - 7980 AS version FROM orders",
    "v_versions": "SELECT version, min(o_orderdate) AS published_at FROM v_orders GROUP BY version",
    "v_writes": "SELECT DISTINCT 'src/' || o_custkey AS source_path, o_custkey, version AS valid_from FROM v_orders",
    "v_contributions": "SELECT source_path, o_custkey, valid_from, lead(valid_from) OVER (PARTITION BY source_path ORDER BY valid_from) - 1 AS valid_to FROM v_writes",
    "v_nodes": """SELECT c.source_path, 'method:' || o.o_orderkey AS node_id, 'typescript:method' AS kind, o.o_orderpriority AS label, 'c' || o.o_custkey || '.' || o.o_orderkey AS qualified_name, c.valid_from, c.valid_to
            FROM v_orders o JOIN v_contributions c ON o.o_custkey = c.o_custkey AND o.version = c.valid_from
        UNION ALL SELECT source_path, 'class:' || o_custkey, 'typescript:class', 'Customer', 'c' || o_custkey, valid_from, valid_to FROM v_contributions""",
    "v_edges": "SELECT c.source_path, 'class:' || o.o_custkey AS source_id, 'method:' || o.o_orderkey AS target_id, 'calls' AS relation, c.valid_from, c.valid_to FROM v_orders o JOIN v_contributions c ON o.o_custkey = c.o_custkey AND o.version = c.valid_from",
    "ws_nodes": "SELECT version, 'project:all' AS node_id, 'project' AS kind, 'all' AS label, 'all' AS qualified_name FROM v_versions UNION ALL SELECT version, 'class:1', 'typescript:class', 'Customer', 'workspace.c1' FROM v_versions",
    "ws_edges": "SELECT DISTINCT version, 'project:all' AS source_id, 'class:' || o_custkey AS target_id, 'contains' AS relation, 'src/' || o_custkey AS owner FROM v_orders",
    "lex_docs": "SELECT doc_id, lang AS title, source AS path, coalesce(text, '') AS body FROM documents",
    "cat_entries": "SELECT 'class:' || c_custkey AS node_id, c_name AS name, c_mktsegment AS synopsis FROM customer",
    "cat_vectors": "SELECT 'class:' || (vec_id // 2) AS node_id, 'source' || (vec_id % 2) AS origin, embedding AS vector FROM embeddings",
    "usage": "SELECT CAST(ts AS DATE) AS day, 'model' || (user_id % 5) AS model, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'actual' || (user_id % 2) END AS actual_model, CASE WHEN user_id % 4 = 0 THEN 'spare' ELSE '' END AS fallback_model, CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE '' END AS effort, event_type AS outcome, CAST(round(value * 1000) AS BIGINT) AS duration, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS tokens, CASE WHEN user_id % 7 = 0 THEN 'unavailable' WHEN user_id % 11 = 0 THEN 'estimate' ELSE 'exact' END AS availability, CASE WHEN user_id % 11 = 0 THEN 'by' || (user_id % 2) ELSE '' END AS estimate_method, value AS budget FROM events",
    "spend": "SELECT event_id AS reservation_id, ts AS recorded_at, CAST(round(value * 100) AS BIGINT) AS amount FROM events WHERE event_type = 'purchase'",
}


def needed(sql: str, have: tuple = ()) -> list[str]:
    """The views that a statement uses, each after those that it is made of."""
    out: list[str] = []
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", sql) and name not in out:
            out += [n for n in needed(body) if n not in out] + [name]
    return list(dict.fromkeys(out))


def with_views(sql: str, dialect: str = "duckdb") -> str:
    """``sql`` behind a WITH clause of the views that it needs."""
    own = [(n, VIEWS[n] if dialect == "duckdb" else VIEWS[n].replace("//", "DIV")) for n in needed(sql)]
    lead = ", ".join(f"{n} AS ({body})" for n, body in own)
    body = sql.strip()
    if not lead:
        return body
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {lead}, {body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {lead}, {body[4:].strip()}"
    return f"WITH {lead} {body}"


class Tables:
    """Attribute access to source tables and derived views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = with_views(f"SELECT * FROM {name}", "spark")
                used = {t: getattr(self, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
                for t in used:
                    sql = re.sub(rf"\b{t}\b(?!\.)", "{" + t + "}", sql)
                self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]
