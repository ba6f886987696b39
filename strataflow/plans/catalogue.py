"""Named queries over the derived graph tables, and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.text import CATALOG, QUESTION, STORE, bm25, diacritics, fold, identifier_tokens, matched_fields, plain_tokens
from strataflow.functions.vectors import cosine
from strataflow.operators import catalog, evidence, export, incremental, lookup, rank, relations, resolve, snapshot, traverse, usage, validate
from strataflow.operators.adjacency import Adjacency
from strataflow.functions.lineage import checkpoint_dir
from strataflow.operators.neighbours import knn_join
from strataflow.schema import RETAINED_VERSIONS
from strataflow.sources import configs
from strataflow.sources.store import Store

from .engine import Engine
from .lexical import LexicalIndex, segment
from .fixtures import Tables, with_views

_QUERIES: dict = {}
_SQL: dict = {}

VERSION = 20
CLASS = "class:7"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_views(sql)
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is connected to a class? Exact lookup, one hop both ways, and the neighbours' names."""
    t = Tables(spark, sf_dir)
    start = lookup.exact(t.g_nodes, CLASS)
    near = traverse.reach(t.g_nodes, t.g_edges, start, "both", None, 1)
    return near.join(t.g_nodes, "node_id").select("node_id", "kind", "label", "qualified_name", "distance").orderBy("distance", "node_id")


VISIBLE = "valid_from <= 20 AND (valid_to IS NULL OR valid_to >= 20)"
NODES_AT = f"SELECT node_id, kind, label, qualified_name FROM v_nodes WHERE {VISIBLE} UNION SELECT node_id, kind, label, qualified_name FROM ws_nodes WHERE version = 20"
EDGES_AT = f"SELECT source_id, target_id, relation FROM v_edges WHERE {VISIBLE} UNION SELECT source_id, target_id, relation FROM ws_edges WHERE version = 20"
NODE_COLUMNS = ["node_id", "kind", "label", "qualified_name"]
EDGE_COLUMNS = ["source_id", "target_id", "relation"]


def nodes_at(t: Tables) -> DataFrame:
    return snapshot.visible(t.v_nodes, t.ws_nodes, VERSION, NODE_COLUMNS)


def edges_at(t: Tables) -> DataFrame:
    return snapshot.visible(t.v_edges, t.ws_edges, VERSION, EDGE_COLUMNS)


def listing(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# --- snapshots -----------------------------------------------------------------------------------


@query("S1_latest_snapshot", "SELECT version, published_at FROM v_versions ORDER BY version DESC LIMIT 1")
def s1(t):
    return snapshot.latest(t.v_versions)


@query("S2_pinned_snapshot", "WITH k AS (SELECT version FROM v_versions WHERE version >= 5), a(version) AS (VALUES (0), (2), (5), (20), (999)) SELECT version, CASE WHEN version IN (SELECT version FROM k) THEN 'found' WHEN version > 0 AND version < (SELECT min(version) FROM k) THEN 'pruned' ELSE 'version not found' END AS status FROM a")
def s2(t):
    return snapshot.pinned(t.v_versions.filter("version >= 5"), listing(t, [(v,) for v in (0, 2, 5, 20, 999)], "version int"))


@query("S3_visible_nodes", NODES_AT)
def s3(t):
    return nodes_at(t)


@query("S4_visible_edges", EDGES_AT)
def s4(t):
    return edges_at(t)


@query("S5_node_of", f"WITH r AS (SELECT node_id, kind, label, qualified_name, source_path, 0 AS k FROM v_nodes WHERE {VISIBLE} UNION ALL SELECT node_id, kind, label, qualified_name, '', 1 FROM ws_nodes WHERE version = 20), n AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k DESC, source_path DESC, kind, label, qualified_name) AS n FROM r) SELECT node_id, kind, label, qualified_name FROM n WHERE n = 1")
def s5(t):
    return snapshot.node_of(t.v_nodes, t.ws_nodes, VERSION)


@query("S6_incident_edges", "SELECT source_id, target_id, relation FROM g_edges WHERE source_id = 'class:7' OR target_id = 'class:7'")
def s6(t):
    return snapshot.incident(t.g_edges, CLASS)


@query("S7_source_contributions", f"WITH n AS (SELECT source_path, list_sort(list(DISTINCT node_id)) AS nodes FROM v_nodes WHERE {VISIBLE} GROUP BY 1), e AS (SELECT source_path, list_sort(list(DISTINCT source_id || '|' || target_id || '|' || relation)) AS edges FROM v_edges WHERE {VISIBLE} GROUP BY 1) SELECT n.source_path, array_to_string(nodes, ' ') AS nodes, array_to_string(coalesce(edges, []), ' ') AS edges FROM n LEFT JOIN e ON n.source_path = e.source_path")
def s7(t):
    c = snapshot.source_contributions(t.v_nodes, t.v_edges, VERSION)
    return c.select("source_path", F.array_join("nodes", " ").alias("nodes"), F.array_join("edges", " ").alias("edges"))


@query("S8_resolver_projections", f"SELECT source_path, declarations, kinds, coalesce(refs, 0) AS refs FROM (SELECT source_path, count(DISTINCT (node_id, kind, label, qualified_name)) AS declarations, count(DISTINCT kind) AS kinds FROM v_nodes WHERE {VISIBLE} GROUP BY 1) LEFT JOIN (SELECT source_path, count(DISTINCT (source_id, target_id, relation)) AS refs FROM v_edges WHERE {VISIBLE} GROUP BY 1) USING (source_path)")
def s8(t):
    found = snapshot.resolver_projections(VERSION, declarations=t.v_nodes, references=t.v_edges)
    return found.select("source_path", F.size("declarations").cast("long").alias("declarations"), F.size(F.array_distinct(F.transform("declarations", lambda d: d["kind"]))).cast("long").alias("kinds"), F.size("references").cast("long").alias("refs"))


@query("S9_projection_page", f"SELECT DISTINCT source_path FROM v_contributions WHERE {VISIBLE} AND source_path > 'src/12' ORDER BY source_path LIMIT 128")
def s9(t):
    return snapshot.page(t.v_contributions.filter(snapshot.at(VERSION)).select("source_path").distinct(), "source_path", "src/12", 128)


@query("S10_resolver_target", f"SELECT node_id, kind, qualified_name FROM v_nodes WHERE {VISIBLE} AND source_path = 'src/7' UNION ALL SELECT source_id, relation, target_id FROM v_edges WHERE {VISIBLE} AND source_path = 'src/7'")
def s10(t):
    found = snapshot.resolver_target(VERSION, "src/7", declarations=t.v_nodes, references=t.v_edges)
    return found["declarations"].select("node_id", "kind", "qualified_name").unionByName(found["references"].select(F.col("source_id").alias("node_id"), F.col("relation").alias("kind"), F.col("target_id").alias("qualified_name")))


@query("S11_package_page", "SELECT node_id FROM g_nodes WHERE kind = 'file' AND regexp_replace(span_path, '/?[^/]*$', '') = 'ASIA' ORDER BY node_id LIMIT 128")
def s11(t):
    return snapshot.package_page(t.g_nodes.filter("kind = 'file'"), "ASIA").select("node_id")


@query("S12_staged_reads", f"WITH s AS (SELECT source_path, node_id FROM v_nodes WHERE valid_from = 21) SELECT source_path, node_id FROM v_nodes WHERE {VISIBLE} AND source_path NOT IN (SELECT source_path FROM s) UNION ALL SELECT source_path, node_id FROM s")
def s12(t):
    now = t.v_nodes.filter(snapshot.at(VERSION)).select("source_path", "node_id")
    staged = t.v_nodes.filter("valid_from = 21").select("source_path", "node_id")
    return snapshot.staged_view(now, staged, staged.select("source_path").distinct())


@query("S13_uncovered_sources", f"SELECT DISTINCT source_path FROM v_contributions WHERE {VISIBLE} AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND 'src/' || c_custkey = source_path)")
def s13(t):
    covered = t.customer.filter("c_acctbal > 0").select(F.concat(F.lit("src/"), F.col("c_custkey")).alias("source_path"))
    return snapshot.uncovered(t.v_contributions, covered, VERSION)


@query("S14_catalog_reads", "SELECT e.node_id, e.name, v.origin, len(v.vector) AS dims FROM cat_entries e LEFT JOIN cat_vectors v ON e.node_id = v.node_id WHERE e.node_id IN ('class:1', 'class:7', 'class:900')")
def s14(t):
    ids = listing(t, [("class:1",), ("class:7",), ("class:900",)], "node_id string")
    return catalog.read(t.cat_entries, t.cat_vectors, ids).select("node_id", "name", "origin", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dims"))


@query("S16_fact_counts", f"WITH n AS ({NODES_AT}), e AS ({EDGES_AT}) SELECT (SELECT count(DISTINCT node_id) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def s16(t):
    return snapshot.fact_counts(nodes_at(t), edges_at(t))


# --- exports -------------------------------------------------------------------------------------


@query("O1_export_edges", f"WITH r AS (SELECT source_id, target_id, relation, source_path AS owner, 0 AS k FROM v_edges WHERE {VISIBLE} UNION ALL SELECT source_id, target_id, relation, owner, 1 FROM ws_edges WHERE version = 20), n AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation ORDER BY k DESC, owner DESC) AS n FROM r) SELECT source_id, target_id, relation, owner FROM n WHERE n = 1")
def o1(t):
    return export.unfiltered_edges(t.v_edges, t.ws_edges, VERSION)


@query("O2_export_filtered", "WITH n AS (SELECT node_id FROM g_nodes WHERE kind IN ('file', 'typescript:class')) SELECT source_id, target_id, relation FROM g_edges WHERE relation IN ('defines', 'imports_from') AND source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n)")
def o2(t):
    return export.filtered(t.g_nodes, t.g_edges, ["file", "typescript:class"], ["defines", "imports_from"])[1].select(*EDGE_COLUMNS)


@query("O3_export_checksum", "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(source_id || chr(9) || target_id || chr(9) || relation), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM g_edges")
def o3(t):
    return export.checksum(t.g_edges, EDGE_COLUMNS)


# --- publication ---------------------------------------------------------------------------------


@query("W5_close_prior", "SELECT source_path, valid_from, lead(valid_from) OVER (PARTITION BY source_path ORDER BY valid_from) - 1 AS valid_to FROM v_writes")
def w5(t):
    return incremental.close_prior(t.v_writes.select("source_path", "valid_from"))


@query("W6_missing_sources", "SELECT DISTINCT source_path FROM v_writes WHERE valid_from < 20 AND source_path NOT IN (SELECT source_path FROM v_writes WHERE valid_from = 20)")
def w6(t):
    return incremental.missing_sources(t.v_writes.filter("valid_from < 20"), t.v_writes.filter("valid_from = 20"))


@query("W7_tombstones", f"SELECT source_path, 21 AS valid_from, 0 AS facts FROM v_contributions WHERE {VISIBLE} AND o_custkey % 10 = 3")
def w7(t):
    now = t.v_contributions.filter(snapshot.at(VERSION))
    return incremental.tombstones(now, t.customer.filter("c_custkey % 10 = 3").select(F.concat(F.lit("src/"), F.col("c_custkey")).alias("source_path")), 21)


@query("W8_retained_edges", "SELECT source_id, target_id, relation, owner FROM ws_edges WHERE version = 20 AND owner NOT IN (SELECT source_path FROM v_writes WHERE valid_from = 21)")
def w8(t):
    return incremental.retain(t.ws_edges, 20, t.v_writes.filter("valid_from = 21")).select("source_id", "target_id", "relation", "owner")


@query("W9_duplicate_sources", "SELECT 'src/' || o_custkey AS source_path, count(*) AS n FROM v_orders WHERE version = 20 GROUP BY 1 HAVING count(*) > 1")
def w9(t):
    return incremental.duplicate_sources(t.v_orders.filter("version = 20").select(F.concat(F.lit("src/"), F.col("o_custkey")).alias("source_path")))


@query("W10_insert_or_ignore", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def w10(t):
    return incremental.first_wins(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("W12_rollback", "SELECT source_path, valid_from, CASE WHEN valid_to < 15 THEN valid_to END AS valid_to FROM v_contributions WHERE valid_from <= 15")
def w12(t):
    return incremental.rollback(t.v_contributions.select("source_path", "valid_from", "valid_to"), 15)


@query("W13_prune_rebase", "SELECT source_path, greatest(valid_from, 12) AS valid_from, valid_to FROM v_contributions WHERE valid_to IS NULL OR valid_to >= 12")
def w13(t):
    return incremental.rebase(t.v_contributions.select("source_path", "valid_from", "valid_to"), 12)


@query("W14_retention", "SELECT version FROM v_versions ORDER BY version DESC LIMIT 25")
def w14(t):
    return snapshot.retained(t.v_versions, RETAINED_VERSIONS)


@query("W17_write_catalog", "SELECT 'class:' || o_custkey AS node_id, arg_max(o_orderpriority, o_orderkey) AS synopsis FROM orders GROUP BY 1")
def w17(t):
    log = t.orders.select(F.concat(F.lit("class:"), F.col("o_custkey")).alias("node_id"), F.col("o_orderpriority").alias("synopsis"), F.col("o_orderkey").alias("seq"))
    return incremental.latest_wins(log, ["node_id"], ["seq"]).drop("seq")


@query("W18_catalog_task", "SELECT o_custkey % 5 AS workspace, version, o_orderstatus AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY version DESC, o_orderkey DESC) AS n FROM v_orders) WHERE n = 1")
def w18(t):
    log = t.v_orders.select((F.col("o_custkey") % 5).alias("workspace"), "version", F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state"))
    return incremental.latest_wins(log, ["workspace"], ["version", "seq"]).drop("seq")


@query("S5_point_read", f"WITH r AS (SELECT node_id, kind, label, qualified_name, source_path, 0 AS k FROM v_nodes WHERE {VISIBLE} AND node_id = 'class:1' UNION ALL SELECT node_id, kind, label, qualified_name, '', 1 FROM ws_nodes WHERE version = 20 AND node_id = 'class:1') SELECT node_id, kind, label, qualified_name FROM r ORDER BY k DESC, source_path DESC LIMIT 1")
def s5b(t):
    return snapshot.point_read(t.v_nodes, t.ws_nodes, VERSION, "class:1")


_QUERIES["S15_read_task"] = lambda spark, d: _QUERIES["W18_catalog_task"](spark, d).filter("workspace = 3")
_SQL["S15_read_task"] = with_views("SELECT * FROM (SELECT o_custkey % 5 AS workspace, version, o_orderstatus AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY version DESC, o_orderkey DESC) AS n FROM v_orders) WHERE n = 1) WHERE workspace = 3")


@query("W19_copy_catalog", f"SELECT node_id, name FROM cat_entries WHERE node_id IN (SELECT node_id FROM ({NODES_AT}))")
def w19(t):
    return catalog.copy_catalog(t.cat_entries.select("node_id", "name"), nodes_at(t))


@query("W20_delete_catalog", "SELECT node_id, name FROM cat_entries WHERE node_id NOT IN (SELECT 'class:' || o_custkey FROM orders WHERE o_orderstatus = 'F')")
def w20(t):
    gone = t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("class:"), F.col("o_custkey")).alias("node_id"))
    return catalog.delete(t.cat_entries.select("node_id", "name"), gone)


@query("W21_write_embeddings", "SELECT 'n' || (vec_id % 100) AS node_id, 's' || label AS origin, len(arg_max(embedding, vec_id)) AS dims, max(vec_id) AS seq FROM embeddings WHERE len(embedding) BETWEEN 1 AND 8192 GROUP BY 1, 2")
def w21(t):
    log = t.embeddings.select(F.concat(F.lit("n"), F.col("vec_id") % 100).alias("node_id"), F.concat(F.lit("s"), F.col("label")).alias("origin"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    return catalog.write_vectors(log).select("node_id", "origin", F.size("vector").alias("dims"), "seq")


#: Facts of the whole orders table.
FACTS = {
    "fn": "SELECT CASE WHEN o_orderkey % 500 = 0 THEN '' ELSE 'm' || (o_orderkey - o_orderkey % 3) END AS node_id, CASE WHEN o_orderkey % 7 = 0 THEN 'widget' ELSE 'typescript:method' END AS kind, CASE WHEN o_orderkey % 11 = 0 THEN 'guessed' ELSE 'extracted' END AS confidence FROM orders",
    "fe": "SELECT 'm' || (o_orderkey - o_orderkey % 3) AS source_id, 'm' || o_orderkey AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN 'likes' ELSE 'typescript:calls' END AS relation, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'inferred' END AS confidence FROM orders",
}


@query(
    "W22_violations",
    f"""WITH fn AS ({FACTS['fn']}), fe AS ({FACTS['fe']}), ids AS (SELECT node_id, min(kind) AS k FROM fn GROUP BY 1),
    e AS (SELECT fe.*, a.k AS sk, b.k AS tk, source_id || '|' || target_id || '|' || relation AS fact FROM fe LEFT JOIN ids a ON a.node_id = source_id LEFT JOIN ids b ON b.node_id = target_id)
    SELECT 1 AS phase, node_id AS fact, 1 AS check_no, 'empty_node_id' AS code FROM fn WHERE node_id = ''
    UNION ALL SELECT 1, node_id, 2, 'unknown_node_kind' FROM fn WHERE kind <> 'typescript:method'
    UNION ALL SELECT 1, node_id, 3, 'invalid_node_evidence' FROM fn WHERE confidence NOT IN ('extracted', 'inferred', 'ambiguous')
    UNION ALL SELECT 1, node_id, 4, 'duplicate_node' FROM fn GROUP BY node_id HAVING count(*) > 1
    UNION ALL SELECT 2, fact, 5, 'unknown_relation' FROM e WHERE relation <> 'typescript:calls'
    UNION ALL SELECT 2, fact, 6, 'invalid_edge_evidence' FROM e WHERE confidence IS NULL
    UNION ALL SELECT 2, fact, 7, 'missing_source' FROM e WHERE sk IS NULL
    UNION ALL SELECT 2, fact, 8, 'missing_target' FROM e WHERE tk IS NULL
    UNION ALL SELECT 2, fact, 9, 'invalid_endpoint' FROM e WHERE sk IS NOT NULL AND tk IS NOT NULL AND relation = 'typescript:calls' AND NOT (sk = 'typescript:method' AND tk = 'typescript:method')""",
)
def w22(t):
    nodes, edges = (t.spark.sql(FACTS[k].replace("FROM orders", "FROM {orders}"), orders=t.orders) for k in ("fn", "fe"))
    kinds = listing(t, [("typescript:method",)], "kind string")
    ends = listing(t, [("typescript:calls", "typescript:method", "typescript:method")], "relation string, source_kind string, target_kind string")
    return validate.violations(nodes, edges, kinds, ends)


@query("W22_first_violation", f"WITH fn AS ({FACTS['fn']}) SELECT 1 AS phase, node_id AS fact, 1 AS check_no, 'empty_node_id' AS code FROM fn WHERE node_id = '' LIMIT 1")
def w22b(t):
    return validate.first_violation(w22(t))


@query("W24_local_references", "SELECT 'src/' || o_custkey AS source_path, 'method:' || (o_orderkey + o_orderkey % 2) AS node_id FROM orders WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.source_path = 'src/' || o_custkey AND n.node_id = 'method:' || (o_orderkey + o_orderkey % 2))")
def w24(t):
    units = t.orders.filter("o_orderkey % 2 = 1").select(F.concat(F.lit("src/"), F.col("o_custkey")).alias("source_path"), F.concat(F.lit("method:"), F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("node_id"))
    return validate.local_references(units, t.v_nodes)


@query("A11_publish_totals", "SELECT valid_from AS version, count(DISTINCT source_path) AS sources, count(*) AS nodes FROM v_nodes GROUP BY 1")
def a11(t):
    return snapshot.publish_totals(t.v_nodes)


# --- incremental ---------------------------------------------------------------------------------

DEPS = "SELECT DISTINCT s.span_path AS source_path, d.span_path AS target_path FROM g_edges e JOIN g_nodes s ON e.source_id = s.node_id JOIN g_nodes d ON e.target_id = d.node_id WHERE e.relation = 'imports_from' AND s.span_path <> d.span_path"


@query("N1_affected_sources", f"WITH deps AS ({DEPS}), ch AS (SELECT n_path AS p FROM g_place WHERE n_nationkey % 6 IN (1, 4) OR n_nationkey = 3) SELECT DISTINCT source_path FROM deps WHERE target_path IN (SELECT p FROM ch) AND source_path NOT IN (SELECT p FROM ch)")
def n1(t):
    files = t.g_place.select(F.col("n_path").alias("source_path"), F.concat(F.lit("file:"), F.col("n_nationkey")).alias("node_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    before = files.filter("k <> 3").select("source_path", "node_id", "name")
    after = files.filter("k % 6 in (1, 4, 5) or k = 3").select("source_path", "node_id", F.when((F.col("k") % 6).isin(1, 4), F.concat("name", F.lit("_new"))).otherwise(F.col("name")).alias("name"))
    deps = incremental.derive_dependencies(t.g_edges.filter("relation = 'imports_from'"), t.g_nodes)
    return incremental.affected(incremental.changed_targets(before, after), deps)


@query("N2_dependencies", DEPS)
def n2(t):
    return incremental.derive_dependencies(t.g_edges.filter("relation = 'imports_from'"), t.g_nodes)


# --- lookup and ranking --------------------------------------------------------------------------


@query("L1_exact_lookup", "SELECT node_id, kind, label, qualified_name FROM g_nodes WHERE node_id = 'ASIA' OR qualified_name = 'ASIA' OR (kind = 'file' AND span_path = 'ASIA') UNION ALL SELECT node_id, kind, label, qualified_name FROM g_nodes WHERE node_id = 'ASIA/NATION_2' OR qualified_name = 'ASIA/NATION_2' OR (kind = 'file' AND span_path = 'ASIA/NATION_2')")
def l1(t):
    return lookup.exact(t.g_nodes, "ASIA").unionByName(lookup.exact(t.g_nodes, "ASIA/NATION_2")).select(*NODE_COLUMNS)


def rank_sql(term: str, kinds: str = "") -> str:
    return f"""SELECT node_id, label, qualified_name, rank FROM (SELECT *, CASE WHEN node_id = '{term}' THEN 0 WHEN qualified_name = '{term}' THEN 1 WHEN lower(label) = lower('{term}') THEN 2
        WHEN starts_with(lower(label), lower('{term}')) OR starts_with(lower(qualified_name), lower('{term}')) OR regexp_matches(lower(label), '[^a-z0-9]' || lower('{term}')) OR regexp_matches(lower(qualified_name), '[^a-z0-9]' || lower('{term}')) THEN 3
        WHEN contains(lower(span_path), lower('{term}')) THEN 4 WHEN contains(lower(node_id), lower('{term}')) OR contains(lower(qualified_name), lower('{term}')) OR contains(lower(label), lower('{term}')) THEN 5 END AS rank FROM g_nodes {kinds})
        WHERE rank IS NOT NULL ORDER BY rank, qualified_name, label, node_id"""


@query("L2_ranked_lookup", rank_sql("Ring") + " LIMIT 200")
def l2_lookup(t):
    return lookup.ranked(t.g_nodes, "Ring", 200).select("node_id", "label", "qualified_name", "rank")


@query("L2_ranked_lookup_scoped", "WITH RECURSIVE s(node_id) AS (SELECT 'project:ASIA' UNION SELECT target_id FROM g_edges JOIN s ON source_id = s.node_id AND relation = 'contains') " + rank_sql("nation", "WHERE kind = 'file' AND node_id IN (SELECT node_id FROM s)") + " LIMIT 50")
def l2_scoped(t):
    scope = traverse.project_scope(t.g_edges, listing(t, [("project:ASIA",)], "node_id string"))
    return lookup.ranked(t.g_nodes, "nation", 50, ["file"], scope).select("node_id", "label", "qualified_name", "rank")


@query("L3_memory_rank", """WITH q(term) AS (VALUES ('ring'), ('Customer#00'), ('ASIA')), k AS (SELECT term, node_id, label, qualified_name, span_path,
    list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+') || regexp_split_to_array(lower(qualified_name), '[^a-z0-9]+'), lambda x: x <> '') AS parts FROM g_nodes, q),
    r AS (SELECT *, CASE WHEN node_id = term THEN 0 WHEN qualified_name = term THEN 1 WHEN label = term THEN 2 WHEN starts_with(lower(label), lower(term)) OR len(list_filter(parts, lambda p: starts_with(p, lower(term)))) > 0 THEN 3
    WHEN contains(lower(span_path), lower(term)) THEN 4 WHEN contains(lower(node_id), lower(term)) OR contains(lower(qualified_name), lower(term)) OR contains(lower(label), lower(term)) THEN 5 END AS rank FROM k),
    n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rank, qualified_name, label, node_id) AS position FROM r WHERE rank IS NOT NULL) SELECT term, position, node_id, rank FROM n WHERE position <= 3""")
def l3(t):
    return lookup.rank_terms(t.g_nodes, ["ring", "Customer#00", "ASIA"])


@query("L4_resolve_exact_first", "SELECT node_id, rank FROM (SELECT node_id, 1 AS rank FROM g_nodes WHERE qualified_name = 'ASIA' UNION ALL (SELECT node_id, rank FROM (" + rank_sql("saturn") + ") LIMIT 3))")
def l4(t):
    return lookup.resolve(t.g_nodes, "ASIA", 3).select("node_id", "rank").unionByName(lookup.resolve(t.g_nodes, "saturn", 3).select("node_id", "rank"))


@query("L5_rank_retrievals", "WITH w AS (SELECT node_id, label, qualified_name, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '') AS x FROM g_nodes) SELECT node_id FROM w WHERE list_contains(x, 'blue') OR len(list_filter(x, lambda p: starts_with(p, 'blue'))) > 0")
def l5(t):
    return bm25(t.g_nodes, "node_id", {"label": plain_tokens(F.col("label"))}, {"label": 10.0}, [["blue"]]).select("node_id")


FOLD = "translate({}, '" + "', '".join(diacritics()) + "')"
WORDS = "list_filter(regexp_split_to_array(lower(" + FOLD + "), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"
#: Weights of the node search fields (fixed values).
SEARCH_WEIGHTS = {"label": 10.0, "qualified_name": 6.0, "span_path": 3.0, "kind": 1.0, "tokens": 5.0}


def search_fields() -> dict:
    all_text = F.concat_ws(" ", "node_id", "label", "qualified_name", "span_path", "kind")
    return {"label": plain_tokens(F.col("label")), "qualified_name": plain_tokens(F.col("qualified_name")), "span_path": plain_tokens(F.col("span_path")), "kind": plain_tokens(F.col("kind")), "tokens": identifier_tokens(fold(all_text))}


def bm25_sql(source: str, key: str, fields: dict[str, tuple[str, float]], terms: list[tuple[str, str]], groups: list[list[int]]) -> str:
    """BM25 in SQL: ``terms`` are (kind, text) with kind prefix or phrase; ``groups`` list AND-ed terms."""
    hits = []
    for i, (kind, text) in enumerate(terms):
        if kind == "prefix":
            one = lambda f, text=text: f"len(list_filter(t_{f}, lambda x: starts_with(x, '{text}')))"
        else:
            words = text.split()
            lst = "[" + ", ".join(f"'{w}'" for w in words) + "]"
            one = lambda f, n=len(words), lst=lst: f"len(list_filter(range(1, len(t_{f}) + 1), lambda i: t_{f}[i:i + {n - 1}] = {lst}))"
        hits.append(" + ".join(f"{w} * {one(f)}" for f, (_, w) in fields.items()) + f" AS h{i}")
    size = " + ".join(f"len(t_{f})" for f in fields)
    arrays = ", ".join(f"{expr} AS t_{f}" for f, (expr, _) in fields.items())
    n = len(terms)
    group_of = {i: g for g in groups for i in g}
    truth = lambda i: "(" + " AND ".join(f"h{j} > 0" for j in group_of[i]) + ")"
    parts = [f"(CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * (CASE WHEN {truth(i)} THEN h{i} ELSE 0 END) * 2.2 / ((CASE WHEN {truth(i)} THEN h{i} ELSE 0 END) + 1.2 * (0.25 + 0.75 * D / avgdl))" for i in range(n)]
    return f"""ws AS (SELECT {key}, {arrays} FROM {source}), hs AS (SELECT {key}, CAST({size} AS DOUBLE) AS D, {', '.join(hits)} FROM ws),
        st AS (SELECT CAST(count(*) AS DOUBLE) AS N, avg(D) AS avgdl, {', '.join(f'CAST(sum(CASE WHEN h{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n{i}' for i in range(n))} FROM hs),
        bm AS (SELECT {key}, round({' + '.join(parts)}, 6) AS score FROM hs, st WHERE {' OR '.join(truth(g[0]) for g in groups)})"""


LEX = {"title": (WORDS.format("title"), 10.0), "path": (WORDS.format("path"), 3.0), "body": (WORDS.format("body"), 1.0)}


@query("L6_bm25", "WITH " + bm25_sql("lex_docs", "doc_id", LEX, [("prefix", "nicht"), ("prefix", "was"), ("prefix", "then"), ("phrase", "of the"), ("prefix", "eau")], [[0], [1, 2], [3], [4]]) + " SELECT doc_id, score FROM bm")
def l6(t):
    fields = {"title": plain_tokens(F.col("title")), "path": plain_tokens(F.col("path")), "body": plain_tokens(F.col("body"))}
    found = bm25(t.lex_docs, "doc_id", fields, {"title": 10.0, "path": 3.0, "body": 1.0}, [["nicht"], ["was", "then"], ["eau"]], ["of the"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


ALL_TEXT = "concat_ws(' ', node_id, label, qualified_name, span_path, kind)"
NODE_FIELDS = {f: (WORDS.format(f), w) for f, w in SEARCH_WEIGHTS.items() if f != "tokens"} | {"tokens": (WORDS.format(f"regexp_replace({FOLD.format(ALL_TEXT)}, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g')"), 5.0)}


@query("L7_match_groups", "WITH " + bm25_sql("g_nodes", "node_id", NODE_FIELDS, [("prefix", "blue"), ("prefix", "wid"), ("prefix", "steel")], [[0, 1], [2]]) + " SELECT node_id, score FROM bm")
def l7(t):
    return bm25(t.g_nodes, "node_id", search_fields(), SEARCH_WEIGHTS, [["blue", "wid"], ["steel"]]).select("node_id", F.round("score", 6).alias("score"))


@query("W16_lexical_index", "WITH " + bm25_sql("g_nodes", "node_id", NODE_FIELDS, [("prefix", "blue"), ("prefix", "wid"), ("prefix", "steel")], [[0, 1], [2]]) + " SELECT node_id, score FROM bm")
def w16(t):
    index = LexicalIndex.build(t.g_nodes, search_fields())
    return index.search(SEARCH_WEIGHTS, [["blue", "wid"], ["steel"]]).select("node_id", F.round("score", 6).alias("score"))


#: The versions of ``v_nodes`` that are published to a store, one after another.
ERAS = (9, 18, 27)
AT_18 = "s18 AS (SELECT node_id, kind, label, qualified_name, source_path AS span_path FROM v_nodes WHERE valid_from <= 18 AND (valid_to IS NULL OR valid_to >= 18))"
AT_27 = AT_18.replace("18", "27")
SEGMENT_TERMS = ([("prefix", "urgent"), ("prefix", "c1"), ("prefix", "medium")], [[0, 1], [2]])


def segment_sql(version: int, at: str) -> str:
    """Search results of one version."""
    return "WITH " + at + ", " + bm25_sql(f"s{version}", "node_id", NODE_FIELDS, *SEGMENT_TERMS) + f" SELECT {version} AS version, node_id, score FROM bm"


@query("W16_segment_merge", f"SELECT * FROM ({segment_sql(18, AT_18)}) UNION ALL SELECT * FROM ({segment_sql(27, AT_27)})")
def w16_segments(t):
    """Three publishes write a segment each of the sources that they replace; search at the second version, and at the
    third after a merge."""
    store = Store(t.spark, f"{checkpoint_dir(t.spark)}/segments-{uuid.uuid4().hex[:12]}")
    out, last = [], 0
    for era in ERAS:
        written = t.v_contributions.filter((F.col("valid_from") > last) & (F.col("valid_from") <= era)).select("source_path", F.lit(False).alias("deleted")).distinct()
        live = t.v_nodes.filter((F.col("valid_from") > last) & snapshot.at(era)).select("source_path", *NODE_COLUMNS)
        store.publish({"nodes": live}, written, segment(live.withColumn("span_path", F.col("source_path")), search_fields()), replaced_owners=written.select("source_path"))
        last = era
    for version, era in ((2, 18), (3, 27)):
        if version == 3:
            store.merge(least=1)
        found = LexicalIndex.stored(store, version).search(SEARCH_WEIGHTS, [["urgent", "c1"], ["medium"]])
        out.append(found.select(F.lit(era).alias("version"), "node_id", F.round("score", 6).alias("score")))
    return out[0].unionByName(out[1])


@query("Q11_scoped_search", "WITH RECURSIVE s(node_id) AS (SELECT 'project:ASIA' UNION SELECT target_id FROM g_edges JOIN s ON source_id = s.node_id AND relation = 'contains'), " + bm25_sql("g_nodes", "node_id", NODE_FIELDS, [("prefix", "nation")], [[0]]) + " SELECT node_id, score FROM bm JOIN g_nodes USING (node_id) WHERE node_id IN (SELECT node_id FROM s) ORDER BY score DESC, qualified_name, node_id LIMIT 50")
def q11(t):
    return Engine(t.g_nodes, t.g_edges, projects=["project:ASIA"]).search("nation", [["nation"]], limit=50).select("node_id", F.round("score", 6).alias("score"))


@query("L5_exact_retrieval", "SELECT node_id, kind, label, qualified_name FROM g_nodes WHERE qualified_name = 'ASIA/NATION_2' OR node_id = 'ASIA/NATION_2' OR (kind = 'file' AND span_path = 'ASIA/NATION_2') ORDER BY qualified_name, label, node_id LIMIT 10")
def l5b(t):
    return Engine(t.g_nodes, t.g_edges).retrieve("ASIA/NATION_2").select(*NODE_COLUMNS)


def tokens_sql(boundary: str, lower: bool) -> str:
    inner = {
        "store": r"regexp_replace(qualified_name, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g')",
        "question": r"regexp_replace(regexp_replace(qualified_name, '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')",
        "catalog": r"regexp_replace(regexp_replace(qualified_name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '([\p{L}\p{Nd}])(\p{Lu}\p{Ll})', '\1 \2', 'g')",
    }[boundary]
    return "array_to_string(list_filter(regexp_split_to_array(" + (f"lower({inner})" if lower else inner) + r", '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), ' ')"


for _name, _boundary, _key, _lower in (("L8_store_tokens", STORE, "store", True), ("L9_question_tokens", QUESTION, "question", False), ("L10_catalog_tokens", CATALOG, "catalog", True)):

    @query(_name, f"SELECT node_id, {tokens_sql(_key, _lower)} AS tokens FROM g_nodes")
    def _tokens(t, boundary=_boundary, lower=_lower):
        return t.g_nodes.select("node_id", F.array_join(identifier_tokens(F.col("qualified_name"), boundary, lower), " ").alias("tokens"))


@query("L11_matched_fields", f"SELECT node_id, array_to_string(list_filter([CASE WHEN list_has_any({WORDS.format('label')}, ['ring', 'asia']) THEN 'label' END, CASE WHEN list_has_any({WORDS.format('qualified_name')}, ['ring', 'asia']) THEN 'qualifiedName' END, CASE WHEN list_has_any({WORDS.format('span_path')}, ['ring', 'asia']) THEN 'path' END], lambda x: x IS NOT NULL), ',') AS fields FROM g_nodes")
def l11(t):
    fields = {"label": plain_tokens(F.col("label")), "qualifiedName": plain_tokens(F.col("qualified_name")), "path": plain_tokens(F.col("span_path"))}
    return t.g_nodes.select("node_id", F.array_join(matched_fields(["ring", "asia"], fields), ",").alias("fields"))


CAT_FIELDS = {"name": (WORDS.format("name"), 8.0), "synopsis": (WORDS.format("synopsis"), 5.0)}
CAT_SEARCH = "WITH " + bm25_sql("cat_entries", "node_id", CAT_FIELDS, [("prefix", "machi"), ("prefix", "0000000")], [[0], [1]]) + ", lx AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, name, node_id) AS position FROM bm JOIN cat_entries USING (node_id))"


@query("L12_search_catalog", CAT_SEARCH + " SELECT node_id, score FROM lx WHERE position <= 50")
def l12(t):
    found = catalog.search(t.cat_entries, "machi 0000000", limit=None).select("node_id", "name", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "name", "node_id").limit(50).select("node_id", "score")


PROBE = [round(0.5 - (i % 8) / 8, 3) for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"CAST({x} AS FLOAT)" for x in PROBE) + "]"


@query("L13_nearest_vectors", f"SELECT node_id, distance FROM (SELECT node_id, round(min(list_distance(CAST(vector AS DOUBLE[]), CAST({PROBE_SQL} AS DOUBLE[]))), 5) AS distance FROM cat_vectors WHERE len(vector) = 64 GROUP BY node_id) ORDER BY distance, node_id LIMIT 20")
def l13(t):
    return catalog.nearest(t.cat_vectors, PROBE, 20, 5)


@query("L13_knn_join", "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND len(q.embedding) = len(e.embedding)) SELECT query_id, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS k FROM p) WHERE k <= 10")
def l13_join(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn_join(rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), rows, 10, digits=5)


@query("L14_cosine", f"SELECT node_id, origin, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST({PROBE_SQL} AS DOUBLE[])), 5) AS similarity FROM cat_vectors")
def l14(t):
    q = F.array(*[F.lit(float(x)).cast("float") for x in PROBE])
    return t.cat_vectors.select("node_id", "origin", F.round(cosine(F.col("vector"), q), 5).alias("similarity"))


@query("L15_cosine_rerank", CAT_SEARCH + f", top AS (SELECT node_id, position FROM lx WHERE position <= 50), s AS (SELECT node_id, round(max(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST({PROBE_SQL} AS DOUBLE[]))), 5) AS similarity FROM cat_vectors WHERE node_id IN (SELECT node_id FROM top) GROUP BY 1) SELECT node_id, position, similarity FROM top LEFT JOIN s USING (node_id) ORDER BY similarity IS NULL, similarity DESC, position LIMIT 10")
def l15(t):
    lexical = catalog.with_position(l12(t).join(t.cat_entries.select("node_id", "name"), "node_id"), F.desc("score"), "name", "node_id").select("node_id", "position")
    return catalog.rerank(lexical, t.cat_vectors, PROBE).select("node_id", "position", F.round("similarity", 5).alias("similarity"))


@query("A10_min_distance", f"SELECT node_id, round(min(list_distance(CAST(vector AS DOUBLE[]), CAST({PROBE_SQL} AS DOUBLE[]))), 5) AS distance FROM cat_vectors WHERE len(vector) = 64 GROUP BY node_id")
def a10(t):
    return catalog.min_distances(t.cat_vectors, PROBE, 5)


CANDIDATES = "ca AS (SELECT node_id, kind, label, qualified_name, span_path, CAST(1 + (length(node_id) * 7 + length(label) * 3) % 11 AS DOUBLE) AS score FROM g_nodes WHERE kind IN ('file', 'typescript:class'))"
PARTS = """co AS (SELECT *, CAST(label = 'NATION_1' AS INT) AS exact, score / max(score) OVER () AS lexical, CAST(regexp_replace(kind, '.*:', '') IN ('class', 'interface', 'type_alias', 'type', 'package', 'module', 'file', 'project') AS INT) AS entity_role,
    CAST(kind = 'file' AS INT) AS node_kind, 0 AS project_scope, (CAST(contains(lower(span_path), 'nation') AS INT) + CAST(contains(lower(span_path), 'asia') AS INT)) / 2 AS path_affinity,
    (CAST(contains(lower(concat_ws(' ', node_id, label, qualified_name, span_path)), 'nation') AS INT) + CAST(contains(lower(concat_ws(' ', node_id, label, qualified_name, span_path)), 'asia') AS INT)) / 2 AS token_coverage FROM ca)"""
RRF = " + ".join(f"CASE WHEN {c} > 0 THEN 1 / (60 + rank() OVER (ORDER BY {c} DESC)) ELSE 0 END" for c in rank.COMPONENTS)
FUSED = f"WITH {CANDIDATES}, {PARTS}, fu AS (SELECT *, round(exact + {RRF}, 9) AS fused FROM co)"


def candidates(t: Tables) -> DataFrame:
    some = t.g_nodes.filter("kind in ('file', 'typescript:class')")
    scored = some.withColumn("score", (1 + (F.length("node_id") * 7 + F.length("label") * 3) % 11).cast("double"))
    return rank.components(scored, "NATION_1", ["nation", "asia"], role="left", kinds=["file"])


@query("L17_seed_components", f"WITH {CANDIDATES}, {PARTS} SELECT node_id, CAST(exact AS DOUBLE) AS exact, round(lexical, 6) AS lexical, CAST(entity_role AS DOUBLE) AS entity_role, CAST(node_kind AS DOUBLE) AS node_kind, CAST(path_affinity AS DOUBLE) AS path_affinity, CAST(token_coverage AS DOUBLE) AS token_coverage FROM co")
def l17(t):
    return candidates(t).select("node_id", "exact", F.round("lexical", 6).alias("lexical"), "entity_role", "node_kind", "path_affinity", "token_coverage")


@query("L18_rrf", FUSED + " SELECT node_id, fused FROM fu")
def l18(t):
    return rank.fuse(candidates(t)).select("node_id", F.round("fused", 9).alias("fused"))


ORDER_SQL = "fused DESC, qualified_name, label, node_id"


@query("L19_diversify", FUSED + f", d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY span_path ORDER BY {ORDER_SQL}) > 1 THEN 1 ELSE 0 END AS deferred FROM fu) SELECT node_id, fused, deferred FROM d ORDER BY deferred, {ORDER_SQL} LIMIT 40")
def l19(t):
    fused = rank.fuse(candidates(t)).withColumn("fused", F.round("fused", 9))
    return rank.diversify(fused, [F.desc("fused"), "qualified_name", "label", "node_id"], "span_path", "node_id", 40).select("node_id", "fused", "deferred")


@query("L20_prefer_exact_label", FUSED + " SELECT node_id, fused FROM fu WHERE lower(label) = 'nation_1'")
def l20(t):
    return rank.prefer_exact_label(rank.fuse(candidates(t)), "nation_1").select("node_id", F.round("fused", 9).alias("fused"))


@query("L21_role_fit", "SELECT kind, CAST(regexp_replace(kind, '.*:', '') IN ('function', 'method') AS DOUBLE) AS callee, CAST(regexp_replace(kind, '.*:', '') IN ('class', 'type') AS DOUBLE) AS service FROM (SELECT DISTINCT kind FROM g_nodes)")
def l21(t):
    return t.g_nodes.select("kind").distinct().select("kind", rank.role_fit(F.col("kind"), "callee").alias("callee"), rank.role_fit(F.col("kind"), "", "service").alias("service"))


# --- graph ---------------------------------------------------------------------------------------

REACH2 = """WITH RECURSIVE o AS (SELECT source_id AS f, target_id AS n FROM g_edges WHERE relation IN ('calls', 'references')), r(node_id, d) AS (SELECT 'class:7', 0 UNION SELECT o.n, d + 1 FROM r JOIN o ON o.f = r.node_id WHERE d < 2) SELECT node_id, min(d) AS distance FROM r GROUP BY 1"""


@query("G1_reach_depth2", REACH2)
def g1(t):
    return traverse.reach(t.g_nodes, t.g_edges, listing(t, [(CLASS,)], "node_id string"), "outgoing", ["calls", "references"], 2)


@query("G1_reach_both", "WITH RECURSIVE o AS (SELECT source_id AS f, target_id AS n FROM g_edges WHERE relation <> 'imports_from' UNION SELECT target_id, source_id FROM g_edges WHERE relation <> 'imports_from'), r(node_id, d) AS (SELECT 'class:7', 0 UNION SELECT o.n, d + 1 FROM r JOIN o ON o.f = r.node_id WHERE d < 2) SELECT node_id, min(d) AS distance FROM r GROUP BY 1")
def g1b(t):
    return traverse.reach(t.g_nodes, t.g_edges.filter("relation <> 'imports_from'"), listing(t, [(CLASS,)], "node_id string"), "both", None, 2)


def as_rows(t: Tables, tr: traverse.Traversal) -> DataFrame:
    return listing(t, [(i, n, tr.levels[n], ",".join(tr.truncated)) for i, n in enumerate(tr.nodes)] or [], "position int, node_id string, distance int, truncated string")


BOTH_WAYS = "o AS MATERIALIZED (SELECT source_id AS f, target_id AS n, source_id, target_id, relation FROM g_edges UNION ALL SELECT target_id, source_id, source_id, target_id, relation FROM g_edges WHERE source_id <> target_id)"
ONE_WAY = "o AS MATERIALIZED (SELECT source_id AS f, target_id AS n, source_id, target_id, relation FROM g_edges WHERE relation IN ('contains', 'defines'))"


def hop_sql(i: int, start: str, room: str) -> str:
    """CTEs k, r, s of hop ``i``: new neighbours with their first key, in order of it, and those that find room."""
    before = f"'{start}'" if i == 1 else f"SELECT n FROM s{i - 1}"
    seen = " ".join([f"AND n <> '{start}'", *(f"AND n NOT IN (SELECT n FROM s{j})" for j in range(1, i))])
    return f"""k{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY n ORDER BY f, source_id, target_id, relation) AS i FROM o WHERE f IN ({before}) {seen} AND n IN (SELECT node_id FROM g_nodes)),
    r{i} AS MATERIALIZED (SELECT n, f, row_number() OVER (ORDER BY f, source_id, target_id, relation) AS p FROM k{i} WHERE i = 1), s{i} AS MATERIALIZED (SELECT n, f, p FROM r{i} WHERE p <= {room})"""


def limited_sql(start: str) -> str:
    """A traversal from one start both ways, at most two hops and 40 nodes."""
    return f"""WITH {BOTH_WAYS}, {hop_sql(1, start, "39")}, {hop_sql(2, start, "39 - (SELECT count(*) FROM s1)")},
    sel AS MATERIALIZED (SELECT '{start}' AS n, 0 AS d, 0 AS p UNION ALL SELECT n, 1, p FROM s1 UNION ALL SELECT n, 2, p FROM s2),
    w AS (SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM r1) > 39 OR (SELECT count(*) FROM r2) > 39 - (SELECT count(*) FROM s1) THEN 'node_limit' END,
        CASE WHEN (SELECT count(*) FROM o SEMI JOIN s2 ON o.f = s2.n ANTI JOIN sel ON o.n = sel.n) > 0 THEN 'depth_limit' END) AS truncated)
    SELECT CAST(row_number() OVER (ORDER BY d, p) - 1 AS INTEGER) AS position, n AS node_id, d AS distance, truncated FROM sel, w"""


@query("G1_traverse_limited", limited_sql(CLASS))
def g1c(t):
    return as_rows(t, traverse.traverse(t.g_nodes, t.g_edges, [CLASS], "both", None, 2, 40))


@query("G1_indexed_traverse", limited_sql(CLASS))
def g1_indexed(t):
    return as_rows(t, traverse.traverse_indexed(Adjacency.build(t.g_nodes, t.g_edges), [CLASS], "both", None, 2, 40))


WALK_STARTS = ("class:7", "class:11", "file:3", "interface:3")


@query("G16_walk_from_each", " UNION ALL ".join(f"SELECT '{s}' AS start, * FROM ({limited_sql(s)})" for s in WALK_STARTS))
def g16_walks(t):
    walks = traverse.walk_from_each(Adjacency.build(t.g_nodes, t.g_edges), list(WALK_STARTS), "both", None, 2, 40)
    return listing(t, [(s, i, n, w.levels[n], ",".join(w.truncated)) for s, w in walks.items() for i, n in enumerate(w.nodes)], "start string, position int, node_id string, distance int, truncated string")


@query("G3_project_scope", "WITH RECURSIVE s(node_id) AS (SELECT 'project:ASIA' UNION SELECT target_id FROM g_edges JOIN s ON source_id = s.node_id AND relation = 'contains') SELECT node_id FROM s")
def g3(t):
    return traverse.project_scope(t.g_edges, listing(t, [("project:ASIA",)], "node_id string"))


@query("G5_beyond_depth", "WITH h1 AS (SELECT target_id AS n FROM g_edges WHERE source_id = 'class:7' AND relation = 'calls') SELECT DISTINCT target_id AS node_id FROM g_edges WHERE source_id IN (SELECT n FROM h1) AND target_id NOT IN (SELECT n FROM h1) AND target_id <> 'class:7'")
def g5(t):
    start = listing(t, [(CLASS,)], "node_id string")
    near = traverse.reach(t.g_nodes, t.g_edges, start, "outgoing", ["calls"], 1)
    hops = traverse.oriented(t.g_edges, "outgoing")
    return near.filter("distance = 1").join(hops, F.col("node_id") == F.col("from_id")).select(F.col("to_id").alias("node_id")).distinct().join(near.select("node_id"), "node_id", "left_anti")


@query("G6_explain", "WITH e AS (SELECT * FROM g_edges WHERE source_id = 'class:7' OR target_id = 'class:7') SELECT node_id, label FROM g_nodes WHERE node_id = 'class:7' OR node_id IN (SELECT source_id FROM e UNION SELECT target_id FROM e)")
def g6(t):
    return traverse.explain(t.g_nodes, t.g_edges, CLASS)[0].select("node_id", "label")


@query("G7_explain_candidates", rank_sql("Customer#00000001") + " LIMIT 4")
def g7(t):
    return lookup.resolve(t.g_nodes, "Customer#00000001", 4).select("node_id", "label", "qualified_name", "rank")


PATHS = """WITH RECURSIVE o AS (SELECT source_id AS f, target_id AS n, source_id || '|' || target_id || '|' || relation AS e FROM g_edges WHERE relation IN ({rels}) {more}),
    p(node_id, d, path) AS (SELECT '{start}', 0, CAST([] AS VARCHAR[]) UNION ALL SELECT o.n, d + 1, list_append(path, o.e) FROM p JOIN o ON o.f = p.node_id WHERE d < {depth}),
    m AS (SELECT *, min(d) OVER (PARTITION BY node_id) AS least FROM p) SELECT node_id, least AS distance, array_to_string(min(path), ' ') AS path FROM m WHERE d = least GROUP BY node_id, least"""


@query("G8_shortest_paths", PATHS.format(rels="'contains', 'defines', 'calls'", more="", start="project:ASIA", depth=3))
def g8(t):
    found = traverse.shortest_paths(t.g_nodes, t.g_edges, listing(t, [("project:ASIA",)], "node_id string"), 3, ["contains", "defines", "calls"])
    return found.select("node_id", "distance", F.array_join("path", " ").alias("path"))


@query("G9_undirected_paths", PATHS.format(rels="'contains', 'defines'", more="UNION ALL SELECT target_id, source_id, source_id || '|' || target_id || '|' || relation FROM g_edges WHERE relation IN ('contains', 'defines')", start="class:7", depth=3))
def g9(t):
    found = traverse.shortest_paths(t.g_nodes, t.g_edges, listing(t, [(CLASS,)], "node_id string"), 3, ["contains", "defines"], undirected=True)
    return found.select("node_id", "distance", F.array_join("path", " ").alias("path"))


@query(
    "G10_find_path",
    f"""WITH {ONE_WAY}, {hop_sql(1, "project:ASIA", "99")}, {hop_sql(2, "project:ASIA", "99 - (SELECT count(*) FROM s1)")}, far AS (SELECT n, f FROM s2 ORDER BY n DESC LIMIT 1)
    SELECT 0 AS position, 'project:ASIA' AS source_id, f AS target_id, 'contains' AS relation FROM far UNION ALL SELECT 1, f, n, 'defines' FROM far""",
)
def g10(t):
    tr = traverse.traverse(t.g_nodes, t.g_edges, ["project:ASIA"], "outgoing", ["contains", "defines"], 8, 100)
    far = max(tr.nodes, key=lambda n: (tr.levels[n], n))
    found = Engine(t.g_nodes, t.g_edges).path("project:ASIA", far, ["contains", "defines"])["path"] or []
    return listing(t, [(i, *e) for i, e in enumerate(found)], "position int, source_id string, target_id string, relation string")


@query("G12_dependents", "SELECT DISTINCT source_id AS node_id FROM g_edges WHERE target_id = 'file:3' AND relation = 'imports_from' AND source_id <> 'file:3'")
def g12(t):
    near = traverse.reach(t.g_nodes, t.g_edges, listing(t, [("file:3",)], "node_id string"), "incoming", relations.dependencies(relations.DEPENDENCY), 1)
    return near.filter("distance = 1").select("node_id")


IMPACT_START = "function:11"


@query(
    "G15_impact",
    """WITH RECURSIVE o AS (SELECT target_id AS f, source_id AS n, source_id, target_id, relation FROM g_edges),
    r(node_id, d) AS (SELECT 'function:11', 0 UNION SELECT o.n, d + 1 FROM r JOIN o ON o.f = r.node_id WHERE d < 2), l AS (SELECT node_id, min(d) AS d FROM r GROUP BY 1),
    k AS (SELECT l.node_id, l.d, o.relation, row_number() OVER (PARTITION BY l.node_id ORDER BY o.f, o.source_id, o.target_id, o.relation) AS n FROM l JOIN o ON o.n = l.node_id JOIN l p ON p.node_id = o.f AND p.d = l.d - 1 WHERE l.d > 0)
    SELECT node_id, d AS distance, relation, (CASE relation WHEN 'contains' THEN 0.25 WHEN 'implements' THEN 0.9 ELSE 1.0 END) / d AS score FROM k WHERE n = 1 AND relation IN ('references', 'implements', 'contains', 'calls', 'imports_from')""",
)
def g15(t):
    near = evidence.impact(t.g_nodes, t.g_edges, listing(t, [(IMPACT_START,)], "node_id string"), 2, relations.impact([*relations.IMPACT, "defines"]))
    return near.filter("relation <> 'defines'")


@query("G17_intersection", "WITH a AS (SELECT target_id AS n FROM g_edges WHERE source_id = 'interface:3' UNION SELECT 'interface:3'), b AS (SELECT target_id AS n FROM g_edges WHERE source_id = 'interface:4' UNION SELECT 'interface:4'), c AS (SELECT g.* FROM g_nodes g WHERE kind LIKE '%interface%') SELECT n AS node_id FROM a WHERE n IN (SELECT n FROM b) UNION SELECT x.node_id FROM c x JOIN c y ON x.span_path = y.span_path OR lower(x.qualified_name) = lower(y.qualified_name) WHERE (x.node_id IN (SELECT n FROM a) AND y.node_id IN (SELECT n FROM b)) OR (x.node_id IN (SELECT n FROM b) AND y.node_id IN (SELECT n FROM a))")
def g17(t):
    side = lambda k: traverse.reach(t.g_nodes, t.g_edges, listing(t, [(k,)], "node_id string"), "outgoing", relations.shared_contract(["implements", "contains"]), 1)
    return evidence.common(t.g_nodes, side("interface:3"), side("interface:4"))


@query("G18_contract_predicates", "SELECT node_id, CASE WHEN contains(kind, 'interface') THEN 'named ' || lower(qualified_name) END AS identity FROM g_nodes")
def g18(t):
    return t.g_nodes.select("node_id", evidence.identity(F.col("kind"), F.col("qualified_name"), F.col("span_path")).alias("identity"))


@query(
    "G19_traversal_evidence",
    """WITH RECURSIVE o AS (SELECT source_id AS f, target_id AS n, source_id, target_id, relation FROM g_edges WHERE relation IN ('calls', 'references')),
    r(node_id, d) AS (SELECT 'class:7', 0 UNION SELECT o.n, d + 1 FROM r JOIN o ON o.f = r.node_id WHERE d < 2), l AS (SELECT node_id, min(d) AS d FROM r GROUP BY 1),
    k AS (SELECT l.node_id, l.d, o.relation, row_number() OVER (PARTITION BY l.node_id ORDER BY o.f, o.source_id, o.target_id, o.relation) AS n FROM l JOIN o ON o.n = l.node_id JOIN l p ON p.node_id = o.f AND p.d = l.d - 1 WHERE l.d > 0)
    SELECT d AS distance, relation, count(*) AS edges, round(1.0 / d * (CASE WHEN relation = 'calls' THEN 1.0 ELSE 0.5 END) * count(*), 6) AS score FROM k WHERE n = 1 GROUP BY 1, 2""",
)
def g19(t):
    found = evidence.traversal_groups(t.g_nodes, t.g_edges, listing(t, [(CLASS,)], "node_id string"), "outgoing", ["calls", "references"], ["calls"], 2)
    return found.select("distance", "relation", "edges", F.round("score", 6).alias("score"))


@query("G21_edge_dedupe", "SELECT DISTINCT 'method:' || l_orderkey AS source_id, 'function:' || l_partkey AS target_id, 'references' AS relation FROM lineitem")
def g21(t):
    raw = t.lineitem.select(F.concat(F.lit("method:"), F.col("l_orderkey")).alias("source_id"), F.concat(F.lit("function:"), F.col("l_partkey")).alias("target_id"), F.lit("references").alias("relation"))
    return raw.dropDuplicates(EDGE_COLUMNS)


# --- usage ---------------------------------------------------------------------------------------


@query("A1_metrics_by_day", "SELECT day, model, actual_model, fallback_model, effort, " + ", ".join(f"sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END)::BIGINT AS n_{o}" for o in usage.OUTCOMES) + ", sum(duration)::BIGINT AS duration, sum(tokens)::BIGINT AS tokens, count(tokens) AS n_tokens, max(budget) AS max_budget FROM usage WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 1, 2, 3, 4, 5")
def a1(t):
    return usage.by_day(t.usage, "2024-01-01", "2024-12-31")


@query("A2_metrics_by_model", "SELECT day, coalesce(nullif(actual_model, ''), model) AS model, " + ", ".join(f"sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END)::BIGINT AS n_{o}" for o in usage.OUTCOMES) + ", sum(duration)::BIGINT AS duration, sum(tokens)::BIGINT AS tokens, count(tokens) AS n_tokens, max(budget) AS max_budget, count(DISTINCT CASE WHEN tokens IS NOT NULL THEN outcome END) AS n_outcomes, min(CASE WHEN availability = 'exact' THEN tokens END) AS least_exact FROM usage GROUP BY 1, 2")
def a2(t):
    return usage.by_model(t.usage)


LATTICE = "SELECT day, model, CASE WHEN e = n OR s = n AND k = 1 THEN total END AS total, CASE WHEN e = n THEN 'exact' WHEN s = n AND k = 1 THEN 'estimate' ELSE 'unavailable' END AS availability FROM (SELECT day, model, sum(tokens)::BIGINT AS total, count(*) AS n, sum(CASE WHEN availability = 'exact' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN availability = 'estimate' THEN 1 ELSE 0 END) AS s, count(DISTINCT CASE WHEN availability = 'estimate' THEN estimate_method END) AS k FROM usage GROUP BY 1, 2)"


@query("A3_availability", LATTICE)
def a3(t):
    return usage.lattice(t.usage, ["day", "model"])


@query("A4_monthly", f"SELECT strftime(day, '%Y-%m') AS month, CASE WHEN bool_and(availability = 'exact') THEN sum(total)::BIGINT END AS total, CASE WHEN bool_and(availability = 'exact') THEN 'exact' ELSE 'unavailable' END AS availability FROM ({LATTICE}) GROUP BY 1")
def a4(t):
    return usage.monthly(usage.lattice(t.usage, ["day", "model"]))


NOW = "TIMESTAMP '2024-01-18 09:30:00'"


@query("A5_spend_windows", "SELECT " + ", ".join(f"coalesce(sum(CASE WHEN recorded_at >= date_trunc('{u}', {NOW}) AND recorded_at <= {NOW} THEN amount END), 0)::BIGINT AS {u}_used" for u in ("day", "week", "month")) + " FROM spend")
def a5(t):
    return usage.windows(t.spend, F.lit("2024-01-18 09:30:00").cast("timestamp"))


@query("A6_settle", "SELECT reservation_id, CASE WHEN reservation_id % 2 = 0 AND reservation_id * 3 <= amount THEN reservation_id * 3 ELSE amount END AS amount FROM spend")
def a6(t):
    fixes = t.spend.filter("reservation_id % 2 = 0").select("reservation_id", (F.col("reservation_id") * 3).alias("amount"))
    return usage.settle(t.spend.select("reservation_id", "amount"), fixes)


@query("A7_nearest_rank", "SELECT event_type, percentile FROM (SELECT event_type, value AS percentile, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = ceil(0.95 * n)")
def a7(t):
    return usage.nearest_rank(t.events, ["event_type"], "value", 0.95)


@query("A8_upper_median", "SELECT event_type, median FROM (SELECT event_type, value AS median, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = n // 2")
def a8(t):
    return usage.upper_median(t.events, ["event_type"], "value")


# --- resolution and catalog ----------------------------------------------------------------------

REFS = "SELECT DISTINCT 'r' || (c_nationkey % 5) || '/n' || c_nationkey || '/c' || c_custkey || '.ts' AS source_path, CASE WHEN c_custkey % 3 = 0 THEN './c' || (c_custkey + 25) WHEN c_custkey % 3 = 1 THEN '../n' || (c_nationkey + 5) || '/c' || (c_custkey + 5) ELSE './lib' || (c_custkey % 4) END AS specifier FROM customer"


def refs(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = t.spark.sql(REFS.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    files = r.select(F.col("source_path").alias("path")).union(t.nation.select(F.format_string("r%d/n%d/lib1/index.ts", F.col("n_nationkey") % 5, F.col("n_nationkey"))))
    return r, files


@query(
    "R1_relative_specifiers",
    f"""WITH r AS ({REFS}), f AS (SELECT source_path AS path FROM r UNION SELECT 'r' || (n_nationkey % 5) || '/n' || n_nationkey || '/lib1/index.ts' FROM nation),
    b AS (SELECT source_path, specifier, CASE WHEN starts_with(specifier, './') THEN regexp_replace(source_path, '/[^/]*$', '') || substr(specifier, 2) ELSE regexp_replace(regexp_replace(source_path, '/[^/]*$', ''), '/[^/]*$', '') || substr(specifier, 3) END AS base FROM r),
    c AS (SELECT source_path, specifier, k, base || e AS path FROM b, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (9, '/index.ts')) AS v(k, e)),
    h AS (SELECT source_path, specifier, arg_min(c.path, k) AS target_path FROM c JOIN f ON c.path = f.path GROUP BY 1, 2) SELECT r.source_path, r.specifier, h.target_path FROM r LEFT JOIN h USING (source_path, specifier)""",
)
def r1(t):
    return resolve.resolve_relative(*refs(t))


@query("R2_path_alias", "WITH p(pattern, head, repl) AS (VALUES ('Brand#*', 'Brand#', 'brands/'), ('Brand#1*', 'Brand#1', 'first/')), b AS (SELECT DISTINCT p_brand AS specifier FROM part), h AS (SELECT specifier, repl || substr(specifier, length(head) + 1) AS target, row_number() OVER (PARTITION BY specifier ORDER BY length(head) DESC) AS n FROM b JOIN p ON starts_with(specifier, head)) SELECT specifier, target FROM h WHERE n = 1")
def r2(t):
    patterns = listing(t, [("Brand#*", "brands/*"), ("Brand#1*", "first/*")], "pattern string, replacement string")
    return resolve.alias_target(t.part.select(F.col("p_brand").alias("specifier")), patterns)


@query("R3_package_walk", f"WITH r AS ({REFS}) SELECT source_path, 'r' || regexp_extract(source_path, '^r(\\d+)', 1) || '/node_modules/lib' AS target FROM r WHERE CAST(regexp_extract(source_path, '^r(\\d+)', 1) AS INT) < 3")
def r3(t):
    asked = refs(t)[0].select("source_path", F.lit("lib").alias("specifier"))
    installed = listing(t, [("package", f"r{i}/node_modules/lib", ".", f"r{i}/node_modules/lib", 0) for i in range(3)], configs.SCHEMA)
    return resolve.package_bases(asked, installed).select("source_path", F.col("base").alias("target"))


@query("R2_nearest_config", f"WITH r AS (SELECT DISTINCT source_path, 'r' || (CAST(regexp_extract(source_path, '^r(\\d+)', 1) AS INT)) AS top FROM ({REFS})) SELECT source_path, '@lib/x' AS specifier, CASE top WHEN 'r0' THEN 'own/x' ELSE 'all/lib/x' END AS base FROM r UNION ALL SELECT source_path, 'plain', CASE top WHEN 'r0' THEN NULL ELSE 'all/plain' END FROM r WHERE top <> 'r0'")
def r2b(t):
    files = refs(t)[0].select("source_path")
    asked = files.withColumn("specifier", F.lit("@lib/x")).union(files.withColumn("specifier", F.lit("plain")))
    rows = [("config", "", "", "", 0), ("base", "", "", "all", 0), ("alias", "", "@lib/*", "all/lib/*", 0), ("config", "r0", "", "", 0), ("alias", "r0", "@lib/*", "own/*", 0), ("alias", "r0", "@*", "wrong/*", 1)]
    return resolve.alias_bases(asked, listing(t, rows, configs.SCHEMA)).select("source_path", "specifier", "base")


@query("R7_go_packages", "WITH s AS (SELECT DISTINCT 'ex.org/' || p_brand || '/pkg' || (p_size % 5) AS specifier FROM part) SELECT 'm.go' AS source_path, specifier, CASE WHEN starts_with(specifier, 'ex.org/Brand#1/') THEN 'local/' || substr(specifier, 16) ELSE 'root/' || substr(specifier, 8) END AS target_dir FROM s")
def r7b(t):
    asked = t.part.select(F.lit("m.go").alias("source_path"), F.concat(F.lit("ex.org/"), F.col("p_brand"), F.lit("/pkg"), F.col("p_size") % 5).alias("specifier"))
    return resolve.go_packages(asked, listing(t, [("module", "root", "ex.org", "root", 0), ("module", "", "ex.org/Brand#1", "gone", 0), ("module", "", "ex.org/Brand#1", "local", 1)], configs.SCHEMA))


CLOSE = "WITH RECURSIVE x AS (SELECT 'p' || n_nationkey AS path, 'p' || (n_nationkey + 7) AS target_path FROM nation WHERE n_nationkey < 18), s AS (SELECT 'p' || (s_suppkey % 25) AS path, CASE WHEN s_suppkey % 9 = 0 THEN 'default' ELSE s_name END AS name, 'interface:' || s_suppkey AS node_id FROM supplier), c(path, name, node_id) AS (SELECT * FROM s UNION SELECT x.path, c.name, c.node_id FROM c JOIN x ON c.path = x.target_path WHERE c.name <> 'default') SELECT path, name, node_id FROM c"


@query("R4_re_export_closure", CLOSE)
def r4(t):
    s = t.supplier.select(F.concat(F.lit("p"), F.col("s_suppkey") % 25).alias("path"), F.when(F.col("s_suppkey") % 9 == 0, "default").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("interface:"), F.col("s_suppkey")).alias("node_id"))
    x = t.nation.filter("n_nationkey < 18").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("path"), F.concat(F.lit("p"), F.col("n_nationkey") + 7).alias("target_path"), F.lit("*").alias("imported"), F.lit("*").alias("exported"))
    return resolve.re_export_closure(s, x)


@query("R5_import_edges", "WITH r AS (SELECT DISTINCT 'f' || l_suppkey AS source_path, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'f' || (l_partkey % 50) END AS target_path FROM lineitem) SELECT source_path, target_path AS target, 'file' AS what FROM r WHERE target_path IS NOT NULL UNION SELECT r.source_path, 'interface:' || s_suppkey, 'surface' FROM r JOIN supplier ON r.target_path = 'f' || s_suppkey")
def r5(t):
    r = t.lineitem.select(F.concat(F.lit("f"), F.col("l_suppkey")).alias("source_path"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("f"), F.col("l_partkey") % 50)).alias("target_path")).distinct()
    return resolve.import_edges(r, t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey")).alias("path"), F.concat(F.lit("interface:"), F.col("s_suppkey")).alias("node_id")))


@query("R6_symbol_targets", "SELECT 'c' || o.o_orderkey AS source_id, 'class:' || c.c_custkey AS target_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def r6(t):
    uses = t.orders.select(F.concat(F.lit("c"), F.col("o_orderkey")).alias("source_id"), F.concat(F.lit("ns."), F.col("o_custkey")).alias("target"), F.lit("").alias("receiver"), F.lit("calls").alias("relation"), F.lit("f").alias("source_path"))
    bindings = listing(t, [("f", "ns", "*", "g")], "source_path string, local string, imported string, target_path string")
    shown = t.customer.select(F.lit("g").alias("path"), F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("class:"), F.col("c_custkey")).alias("node_id"))
    return resolve.bound_targets(uses, bindings, shown).select("source_id", "target_id")


@query("R7_longest_prefix", "WITH p AS (SELECT DISTINCT n_path || '/c' || (c_custkey % 9) AS path FROM customer JOIN g_place ON c_nationkey = n_nationkey), r(root) AS (VALUES ('ASIA'), ('ASIA/NATION_2'), ('EUROPE/NATION_3'), ('AFRICA/NATION')), k AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS n FROM p JOIN r ON path = root OR starts_with(path, root || '/')) SELECT path, root FROM k WHERE n = 1")
def r7(t):
    paths = t.customer.join(t.g_place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("n_path", F.lit("/c"), F.col("c_custkey") % 9).alias("path")).distinct()
    return resolve.longest_prefix(paths, "path", listing(t, [("ASIA",), ("ASIA/NATION_2",), ("EUROPE/NATION_3",), ("AFRICA/NATION",)], "root string"))


@query("R8_package_imports", "SELECT a.node_id AS source_id, b.node_id AS target_id FROM g_nodes a JOIN g_nodes b ON regexp_replace(a.span_path, '/?[^/]*$', '') = regexp_replace(b.span_path, '/?[^/]*$', '') WHERE a.kind = 'file' AND b.kind = 'file' AND a.node_id <> b.node_id")
def r8(t):
    f = t.g_nodes.filter("kind = 'file'").select("node_id", resolve.dirname(F.col("span_path")).alias("dir"))
    return resolve.package_edges(f.select(F.col("node_id").alias("source_id"), F.col("dir").alias("target_dir")), f)


@query("R9_unique_calls", "WITH c AS (SELECT p_partkey AS call_id, p_name AS name FROM part), d AS (SELECT p_name AS name, count(*) AS matches, min('function:' || p_partkey) AS node_id FROM part GROUP BY 1) SELECT call_id, CASE WHEN matches = 1 THEN node_id END AS node_id, coalesce(matches, 0) AS matches FROM c LEFT JOIN d ON c.name = d.name")
def r9(t):
    return resolve.unique_matches(t.part.select(F.col("p_partkey").alias("call_id"), F.col("p_name").alias("name")), t.part.select(F.col("p_name").alias("name"), F.concat(F.lit("function:"), F.col("p_partkey")).alias("node_id")), ["name"])


@query("R10_method_calls", "WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS receiver, l_partkey AS name FROM lineitem), d AS (SELECT l_suppkey AS receiver, l_partkey AS name, count(*) AS matches, min('m' || l_orderkey) AS node_id FROM lineitem GROUP BY 1, 2) SELECT call_id, CASE WHEN matches = 1 THEN node_id END AS node_id, coalesce(matches, 0) AS matches FROM c LEFT JOIN d USING (receiver, name)")
def r10(t):
    base = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("receiver"), F.col("l_partkey").alias("name"), F.concat(F.lit("m"), F.col("l_orderkey")).alias("node_id"))
    return resolve.unique_matches(base.select("call_id", "receiver", "name"), base.select("receiver", "name", "node_id"), ["receiver", "name"])


DIV_HAVE = "SELECT DISTINCT 'p' || (l_suppkey % 3) AS package, 's' || l_suppkey AS type_id, 'm' || (l_partkey % 12) AS name FROM lineitem"
DIV_NEED = "SELECT 'p' || (p_partkey % 3) AS package, 'i' || p_partkey AS interface_id, 'm' || (p_size % 12) AS name FROM part UNION SELECT 'p' || (p_partkey % 3), 'i' || p_partkey, 'm' || (p_partkey % 12) FROM part"


@query(
    "R11_implements_division",
    f"""WITH h AS ({DIV_HAVE}), d AS ({DIV_NEED}), hs AS (SELECT package, type_id AS id, list_sort(list(DISTINCT name)) AS names FROM h GROUP BY 1, 2), ds AS (SELECT package, interface_id AS id, list_sort(list(DISTINCT name)) AS names FROM d GROUP BY 1, 2),
    hc AS (SELECT package, names, min(id) AS class_id FROM hs GROUP BY 1, 2), dc AS (SELECT package, names, min(id) AS class_id FROM ds GROUP BY 1, 2),
    n AS (SELECT package, interface_id, count(DISTINCT name) AS need FROM d GROUP BY 1, 2),
    every AS (SELECT h.type_id, d.interface_id FROM h JOIN d ON h.package = d.package AND h.name = d.name JOIN n ON n.package = d.package AND n.interface_id = d.interface_id GROUP BY h.package, h.type_id, d.interface_id, n.need HAVING count(*) = n.need)
    SELECT 'implements' AS what, hc.class_id AS a, dc.class_id AS b FROM hc JOIN dc ON hc.package = dc.package AND list_has_all(hc.names, dc.names)
    UNION ALL SELECT 'type', class_id, id FROM hs JOIN hc USING (package, names) UNION ALL SELECT 'interface', class_id, id FROM ds JOIN dc USING (package, names) UNION ALL SELECT 'pair', type_id, interface_id FROM every""",
)
def r11(t):
    """Every pair of a type and an interface that it implements; pairs of classes, and the members of both kinds of classes."""
    have = t.spark.sql(DIV_HAVE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)
    need = t.spark.sql(DIV_NEED.replace("FROM part", "FROM {part}"), part=t.part)
    pairs, types, interfaces = resolve.implement_classes(have, need)
    rows = pairs.select(F.lit("implements").alias("what"), F.col("have_id").alias("a"), F.col("need_id").alias("b"))
    member = lambda df, what: df.select(F.lit(what).alias("what"), F.col("class_id").alias("a"), F.col("id").alias("b"))
    every = resolve.implement_pairs(pairs, types, interfaces).select(F.lit("pair").alias("what"), F.col("type_id").alias("a"), F.col("interface_id").alias("b"))
    return rows.unionByName(member(types, "type")).unionByName(member(interfaces, "interface")).unionByName(every)


@query("C1_synopsis", "SELECT node_id, substr(split_part(qualified_name, '::', 1) || '.' || label || ' (' || regexp_replace(kind, '.*:', '') || '). Lives in ' || span_path || ' Signature: new ' || label || '(). Identifiers: ' || " + tokens_sql("catalog", True).replace("qualified_name", "label") + ", 1, 300) AS synopsis FROM g_nodes WHERE kind = 'typescript:class'")
def c1(t):
    n = t.g_nodes.filter("kind = 'typescript:class'")
    return n.select("node_id", catalog.synopsis(F.col("label"), F.substring_index("qualified_name", "::", 1), F.col("kind"), F.array(F.concat(F.lit("Lives in "), F.col("span_path"))), F.concat(F.lit("new "), F.col("label"), F.lit("()")), catalog.unit_tokens(F.col("label"))).alias("synopsis"))


@query("C3_reuse", "SELECT node_id, CASE WHEN CAST(substr(node_id, 7) AS INT) % 4 <> 0 AND CAST(substr(node_id, 7) AS INT) % 5 <> 0 THEN 'kept' END AS written, CAST(substr(node_id, 7) AS INT) % 4 <> 0 AND CAST(substr(node_id, 7) AS INT) % 5 <> 0 AS reused FROM cat_entries")
def c3(t):
    k = F.substring("node_id", 7, 20).cast("int")
    fresh = t.cat_entries.withColumn("fingerprint", catalog.fingerprint(["name", "synopsis"]))
    stored = fresh.filter(k % 4 != 0).select("node_id", F.when(k % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), "fingerprint", "synopsis", F.lit("kept").alias("written"))
    return catalog.reuse(fresh, stored).select("node_id", "written", "reused")


@query("C4_missing_embeddings", "SELECT node_id, name FROM cat_entries WHERE node_id NOT IN (SELECT node_id FROM cat_vectors)")
def c4(t):
    return catalog.missing_embeddings(t.cat_entries.select("node_id", "name"), t.cat_vectors, ["node_id"])


# --- questions, sources, feed --------------------------------------------------------------------

from strataflow.plans import question as Q  # noqa: E402
from strataflow.sources import discovery, extract  # noqa: E402
from strataflow.streaming import feed  # noqa: E402

ASKED = "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Who calls ' || c_name || '?' WHEN 1 THEN 'what does ' || c_name || ' call' WHEN 2 THEN 'Explain ' || c_name WHEN 3 THEN 'How does ' || c_name || ' reach PaymentStore?' WHEN 4 THEN 'What is affected if ' || c_name || ' changes?' WHEN 5 THEN 'where is the ' || c_mktsegment || ' folder' WHEN 6 THEN 'what do A and \"B c\" have in common' WHEN 7 THEN 'Does the workspace use ' || c_name || '?' ELSE 'tell me about ' || c_name END AS asked FROM customer"


def asked(t: Tables) -> DataFrame:
    return t.spark.sql(ASKED.replace("FROM customer", "FROM {customer}"), customer=t.customer)


@query("Q1_intents", f"SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'called_by' WHEN 1 THEN 'calls' WHEN 2 THEN 'explain' WHEN 3 THEN 'path' WHEN 4 THEN 'impact' WHEN 5 THEN 'lookup' WHEN 6 THEN 'shared_contract' WHEN 7 THEN 'capability' ELSE 'unknown' END AS intent FROM ({ASKED})")
def q1(t):
    return asked(t).select("c_custkey", Q.intent_column(F.col("asked")).alias("intent"))


@query("Q5_terms", "WITH w AS (SELECT c_custkey, list_filter(regexp_split_to_array(lower(asked), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in Q.STOP_WORDS) + f")) AS t FROM (SELECT c_custkey, regexp_replace(regexp_replace(asked, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g') AS asked FROM ({ASKED}))) SELECT c_custkey, array_to_string(list_transform(t, lambda x: CASE x WHEN 'affected' THEN 'impact' WHEN 'common' THEN 'shared' ELSE x END), ' ') AS terms FROM w")
def q5(t):
    return asked(t).select("c_custkey", F.array_join(Q.terms_column(F.col("asked")), " ").alias("terms"))


@query("Q6_phrases", f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 6 THEN 'B c' ELSE '' END AS phrases FROM ({ASKED})")
def q6(t):
    return asked(t).select("c_custkey", F.array_join(Q.phrases_column(F.col("asked")), "|").alias("phrases"))


FILES = "SELECT 'r' || (p_partkey % 4) || '/' || CASE p_size % 5 WHEN 0 THEN 'node_modules/x' WHEN 1 THEN 'src' WHEN 2 THEN 'src/deep' ELSE 'test' END || '/' || CASE WHEN p_partkey % 50 < 4 THEN 'package.json' ELSE 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.go' ELSE '.md' END END AS path FROM part"


def file_paths(t: Tables) -> DataFrame:
    return t.spark.sql(FILES.replace("FROM part", "FROM {part}"), part=t.part).distinct()


@query("I2_project_roots", f"SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root, 'project:' || regexp_replace(path, '/?[^/]*$', '') AS project_id FROM ({FILES}) WHERE ends_with(path, '/package.json')")
def i2(t):
    return discovery.project_roots(file_paths(t))


@query("I3_owners", f"WITH f AS (SELECT DISTINCT path FROM ({FILES})), r AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS root FROM f WHERE ends_with(path, '/package.json')), k AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS n FROM f JOIN r ON starts_with(path, root || '/')) SELECT path, root, 'project:' || root AS project_id FROM k WHERE n = 1")
def i3(t):
    f = file_paths(t)
    return discovery.owned(f, discovery.project_roots(f)).select("path", "root", "project_id")


@query("I4_globs", f"SELECT DISTINCT path FROM ({FILES}) WHERE regexp_matches(path, '^(.*/)?src/(.*/)?[^/]*\\.(ts|go)$') AND NOT regexp_matches(path, '^r2/')")
def i4(t):
    return file_paths(t).filter(discovery.included(F.col("path"), ["**/src/**/*.{ts,go}"], ["r2/**"]))


@query("I5_ignore_rules", f"SELECT DISTINCT path, (contains(path, '/deep/') OR ends_with(path, '.md')) AND NOT (starts_with(path, 'r1/') AND ends_with(path, '.md') AND NOT contains(path, '/deep/')) AS ignored FROM ({FILES})")
def i5(t):
    ignored = discovery.ignored_column(t.spark, {"": "deep/\n*.md\n", "r1": "# keep notes\n!*.md\n"})
    return file_paths(t).select("path", ignored(F.col("path")).alias("ignored"))


@query("I6_internal_dirs", f"SELECT DISTINCT path FROM ({FILES}) WHERE NOT contains('/' || path, '/node_modules/')")
def i6(t):
    return file_paths(t).filter(~discovery.internal(F.col("path")))


@query("I7_languages", f"SELECT DISTINCT path, CASE WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.go') THEN 'go' END AS language FROM ({FILES})")
def i7(t):
    return file_paths(t).select("path", discovery.language(F.col("path")).alias("language"))


SOURCES = "SELECT p_partkey, 'src/f' || p_partkey || '.go' AS path, 'go' AS language, 'package p' || chr(10) || 'func F' || p_partkey || '(a int) ' || chr(123) || chr(125) || chr(10) || 'type t' || p_size || ' struct ' || chr(123) || chr(10) || chr(125) || chr(10) || 'import \"lib/' || (p_size % 7) || '\"' AS content FROM part"


@query("I9_extract_nodes", f"SELECT path AS source_path, 'file' AS kind, 'f' || p_partkey || '.go' AS label, 1 AS line, true AS exported FROM ({SOURCES}) UNION ALL SELECT 'src/f' || p_partkey || '.go', 'go:function', 'F' || p_partkey, 2, true FROM part UNION ALL SELECT 'src/f' || p_partkey || '.go', 'go:struct', 't' || p_size, 3, false FROM part UNION ALL SELECT 'src/f' || p_partkey || '.go', 'go:package', 'p', 1, true FROM part")
def i9(t):
    sources = t.spark.sql(SOURCES.replace("FROM part", "FROM {part}"), part=t.part)
    return extract.extract(sources).select("source_path", "kind", "label", "line", "exported")


SCRIPTS = "SELECT p_partkey, 'src/f' || p_partkey || '.js' AS path, 'javascript' AS language, 'import d, ' || chr(123) || ' a as b ' || chr(125) || ' from ' || chr(39) || './m' || (p_size % 7) || chr(39) || chr(10) || 'const r = require(' || chr(39) || 'lib/' || (p_size % 5) || chr(39) || ')' || chr(10) || 'export * from \"./all\"' || chr(10) || 'import(p ? \"./x\" : \"./y\" + \"z\")' || chr(10) || 'export class C' || p_size || ' extends d ' || chr(123) || ' m(x) ' || chr(123) || ' this.n(); b(x); r.open() ' || chr(125) || ' ' || chr(125) AS content FROM part"


@query("I10_extract_references", "WITH s AS (SELECT 'src/f' || p_partkey || '.js' AS source_path, p_size FROM part) SELECT source_path, './m' || (p_size % 7) AS specifier, 'import' AS kind, false AS ambiguous, 'default>d a>b' AS bindings FROM s UNION ALL SELECT source_path, 'lib/' || (p_size % 5), 'require', false, '*>r' FROM s UNION ALL SELECT source_path, './all', 're_export', false, '*>*' FROM s UNION ALL SELECT source_path, './x', 'import', true, '' FROM s UNION ALL SELECT source_path, './yz', 'import', true, '' FROM s")
def i10(t):
    found = extract.extract(t.spark.sql(SCRIPTS.replace("FROM part", "FROM {part}"), part=t.part), "references")
    return found.select("source_path", "specifier", "kind", "ambiguous", F.array_join(F.transform("bindings", lambda b: F.concat(b["imported"], F.lit(">"), b["local"])), " ").alias("bindings"))


@query("I10_extract_symbols", "WITH s AS (SELECT 'src/f' || p_partkey || '.js' AS p, 'C' || p_size AS c FROM part) SELECT 'javascript:class:' || p || '#' || c AS source_id, 'd' AS target, '' AS receiver, 'javascript:extends' AS relation FROM s UNION ALL SELECT 'javascript:method:' || p || '#' || c || '.m', 'n', c, 'javascript:calls' FROM s UNION ALL SELECT 'javascript:method:' || p || '#' || c || '.m', 'b', '', 'javascript:calls' FROM s UNION ALL SELECT 'javascript:method:' || p || '#' || c || '.m', 'r.open', '', 'javascript:calls' FROM s")
def i10b(t):
    return extract.extract(t.spark.sql(SCRIPTS.replace("FROM part", "FROM {part}"), part=t.part), "symbols").select("source_id", "target", "receiver", "relation")


TYPED = "SELECT 'src/f' || p_partkey || '.ts' AS path, 'typescript' AS language, 'export interface I' || p_size || ' extends J<string> ' || chr(123) || ' a(): void ' || chr(125) || chr(10) || 'type U = ' || chr(123) || ' x: number ' || chr(125) || chr(10) || 'export default class K implements I' || p_size || ', ns.L ' || chr(123) || ' get(): Promise<void> ' || chr(123) || ' return f() ' || chr(125) || ' ' || chr(125) AS content FROM part"


@query("I11_extract_nodes", "WITH s AS (SELECT 'src/f' || p_partkey || '.ts' AS source_path, 'f' || p_partkey || '.ts' AS f, p_size FROM part) SELECT source_path, 'file' AS kind, f AS label, 1 AS line, 3 AS end_line, true AS exported FROM s UNION ALL SELECT source_path, 'typescript:interface', 'I' || p_size, 1, 1, true FROM s UNION ALL SELECT source_path, 'typescript:type_alias', 'U', 2, 2, false FROM s UNION ALL SELECT source_path, 'typescript:class', 'K', 3, 3, true FROM s UNION ALL SELECT source_path, 'typescript:method', 'get', 3, 3, false FROM s")
def i11(t):
    return extract.extract(t.spark.sql(TYPED.replace("FROM part", "FROM {part}"), part=t.part)).select("source_path", "kind", "label", "line", "end_line", "exported")


@query("I11_heritage", "WITH s AS (SELECT 'src/f' || p_partkey || '.ts' AS p, p_size FROM part) SELECT 'typescript:interface:' || p || '#I' || p_size AS source_id, 'J' AS target, 'typescript:extends' AS relation FROM s UNION ALL SELECT 'typescript:class:' || p || '#K', 'I' || p_size, 'typescript:implements' FROM s UNION ALL SELECT 'typescript:class:' || p || '#K', 'ns.L', 'typescript:implements' FROM s")
def i11b(t):
    found = extract.extract(t.spark.sql(TYPED.replace("FROM part", "FROM {part}"), part=t.part), "symbols")
    return found.filter("not endswith(relation, 'calls')").select("source_id", "target", "relation")


@query("T1_coalesced_changes", "SELECT 'u' || (user_id % 40) || '/f.ts' AS path, min(ts) AS ts FROM events GROUP BY 1")
def t1(t):
    return feed.coalesce_paths(t.events.select("ts", F.concat(F.lit("./u"), F.col("user_id") % 40, F.lit("/x/../f.ts")).alias("path")))


@query("T4_reconcile", "SELECT 'f' || o_orderkey AS path FROM orders WHERE (o_orderkey % 3 = 0) <> (o_orderkey % 2 = 0) OR (o_orderkey % 6 = 0 AND o_orderpriority LIKE '1%')")
def t4(t):
    path = F.concat(F.lit("f"), F.col("o_orderkey")).alias("path")
    disk = t.orders.filter("o_orderkey % 3 = 0").select(path, F.lit("a").alias("hash"))
    indexed = t.orders.filter("o_orderkey % 2 = 0").select(path, F.when(F.col("o_orderpriority").startswith("1"), "b").otherwise("a").alias("hash"))
    return feed.reconcile(disk, indexed)


@query("T6_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t6(t):
    return feed.windowed_counts(t.events)
