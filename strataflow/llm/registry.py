"""Names, queries and SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, near_dedup, pieces, quality, resampling, token_shards, toxicity, trie, url_filter, vantage, warc
from .common import Scratch, held_out, read

#: Per query: its function, and its DuckDB SQL where SQL can express it.
_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.evidence").alias("evidence"),
    )


@query(
    "op8_exact_dedup",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
    FROM t JOIN g ON t.text = g.text""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


@query(
    "op5_minhash_near_dedup",
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS shingles FROM d),
    x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) AS component_id, least(s.doc_id, coalesce(c.b, s.doc_id)) = s.doc_id AS kept FROM s LEFT JOIN c ON c.a = s.doc_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(read(spark, sf_dir, "documents"), near_dedup.Params(words=4, percent=80))


LEAKS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents WHERE doc_id IS NOT NULL),
    i AS (SELECT row_number() OVER () AS k, item_id, t, len(t) AS n, least(len(t), 13) AS w FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) >= 5),
    dt AS (SELECT r, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM d), it AS (SELECT k, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM i),
    m AS (SELECT r, k, dt.p - it.p AS g, list(it.p) AS ps, count(*) AS matched FROM dt JOIN it ON dt.x = it.x GROUP BY r, k, dt.p - it.p HAVING count(*) >= 4),
    b AS (SELECT d.doc_id, i.item_id, g, n, matched, w, list_max(list_transform(range(1, n - w + 2), lambda s: len(list_filter(ps, lambda q: q >= s AND q < s + w)))) AS best FROM m JOIN i ON i.k = m.k JOIN d ON d.r = m.r WHERE matched >= ceil(w * 0.8)),
    z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, matched DESC, g) AS o FROM b WHERE best >= ceil(w * 0.8))
    SELECT doc_id, item_id, CAST(g AS BIGINT) AS doc_offset, CAST(n AS BIGINT) AS item_tokens, CAST(matched AS BIGINT) AS matched_tokens, round(best / w, 6) AS best_window FROM z WHERE o = 1"""


@query("op6_decontaminate", LEAKS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.load(), n=2)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op10_quality_crf")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The rule list of op3: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query(
    "op3_url_filter",
    r"""WITH r(h, p, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    u AS (SELECT page_id,
        CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
        CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM pages),
    f AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.action, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
        FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query(
    "op7_chat_format",
    r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS position, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY position) AS turns, count(*) AS n FROM t GROUP BY conv_id),
    p AS (SELECT turns[1:k] AS turns, k FROM c, unnest(range(1, n)) AS u(k)),
    f AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns),
    k AS (SELECT conv_id FROM f WHERE turns NOT IN (SELECT turns FROM p))
    SELECT conv_id, position, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, role = 'assistant' AS is_target FROM t WHERE conv_id IN (SELECT conv_id FROM k)""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


@query(
    "op4_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    g AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body),
    h AS (SELECT p.page_id, strlen(p.body) AS payload_bytes, sha1(p.body) AS hex, g.first_id FROM p JOIN g ON p.body = g.body),
    d AS (SELECT h.*, list_transform(range(0, 32), lambda k: list_reduce(list_transform(range(0, 5), lambda j: (CAST(instr('0123456789abcdef', substr(hex, CAST((5 * k + j) // 4 AS INTEGER) + 1, 1)) - 1 AS INTEGER) >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1), lambda a, b: a * 2 + b)) AS fives FROM h)
    SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "warc").path("captures")
    parts = warc.write(read(spark, sf_dir, "pages"), root)
    return warc.scan(spark, parts, by_index=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_token_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "token-shards").path("shards")
    return token_shards.write(read(spark, sf_dir, "documents"), root)


#: crc32 in SQL: the table of one byte's steps, and the checksum of a text's UTF-8 bytes ({0}) by it.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY n) AS tbl FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n)))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: (instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 2, 1)) - 1)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"


@query(
    "op11_importance_resampling",
    rf"""WITH {CRC_TABLE},
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    i AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    o AS (SELECT r, unnest(words) AS w FROM d),
    v AS (SELECT w, {CRC.format('w')} % 10000 AS bucket FROM (SELECT w FROM o UNION SELECT w FROM i), crc),
    s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM i JOIN v USING (w) GROUP BY bucket),
    n AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS S_all, (SELECT count(*) FROM i)::DOUBLE AS T_all),
    g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (S_all + 10000) / ((s.s + 1.0::DOUBLE) * (T_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
    a AS (SELECT r, sum(gain) AS total FROM o JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
    b AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE CAST(floor(total::DOUBLE / len(words)) AS BIGINT) END AS weight,
        CAST(concat('0x', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN a ON d.r = a.r),
    c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM b),
    k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM c)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM c WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM k""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    "op12_conversation_trie",
    rf"""WITH {CRC_TABLE},
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY p) AS turns FROM t GROUP BY conv_id),
    h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, CAST({CRC.format('conv_id::VARCHAR')} % 4 AS BIGINT) AS h FROM o, crc),
    b AS (SELECT h.conv_id, list_concat(coalesce(o.turns[1:h.h], []), coalesce(h.turns[h.h + 1:], [])) AS turns FROM h LEFT JOIN o ON o.conv_id = h.base),
    m AS (SELECT conv_id, turns[1:d] AS path, d, len(turns) AS n FROM b, unnest(range(0, len(turns) + 1)) AS u(d)),
    a AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY path, d),
    k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM a WHERE depth > 0 GROUP BY 1, 2),
    e AS (SELECT a.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * len(regexp_extract_all(a.path[a.depth].text, '[^\x20\x09-\x0D]+')) END AS saving FROM a LEFT JOIN k ON k.path = a.path AND k.depth = a.depth),
    s AS (SELECT e.path[1:x.d] AS path, x.d AS depth, sum(CASE WHEN e.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(e.saving) AS saved_tokens FROM e, unnest(range(0, e.depth + 1)) AS x(d) GROUP BY 1, 2)
    SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
    FROM e JOIN s ON s.path = e.path AND s.depth = e.depth LEFT JOIN a u ON e.depth > 0 AND u.depth = e.depth - 1 AND u.path = e.path[1:e.depth - 1]""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    nodes = trie.trie(read(spark, sf_dir, "conversations"), c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, most=3)
    return nodes.drop("pos", "stop")


@query(
    "op13_vantage_neighbours",
    """WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
    u AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
    p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (q.norm * c.norm) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.x) = len(c.x))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vantage.nearest(rows.filter("vec_id % 50 = 0"), vantage.build(rows))
