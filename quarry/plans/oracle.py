"""SQL of the core's queries: SHARED runs as it is on Spark and on the comparison engine, SQL on the latter only."""

from __future__ import annotations

from quarry.functions import text as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings kb_project kb_document chat_session message intent intent_resolution emb_minilm_384 "
    "subject_area subject_label role_alias container_size mix_target"
).split()

SHARED = {
    "table_counts": """
SELECT 'kb_document' AS name, count(*) AS n FROM kb_document UNION ALL SELECT 'message', count(*) FROM message UNION ALL SELECT 'intent', count(*) FROM intent
UNION ALL SELECT 'intent_resolution', count(*) FROM intent_resolution UNION ALL SELECT 'emb_minilm_384', count(*) FROM emb_minilm_384 UNION ALL SELECT 'documents', count(*) FROM documents""",
    "intent_list": """
WITH best AS (SELECT intent_id, id, outcome, score, row_number() OVER (PARTITION BY intent_id ORDER BY score DESC NULLS LAST, id DESC) AS r
  FROM (SELECT DISTINCT intent_id, id, outcome, score FROM intent_resolution WHERE response_excerpt IS NOT NULL AND response_excerpt <> '') x),
n AS (SELECT intent_id, count(DISTINCT id) AS resolutions FROM intent_resolution GROUP BY intent_id),
i AS (SELECT id, max(frequency) AS frequency, max(last_seen) AS last_seen FROM intent GROUP BY id)
SELECT i.id, i.frequency, b.id AS best, b.score, coalesce(n.resolutions, 0) AS resolutions
FROM i LEFT JOIN best b ON b.intent_id = i.id AND b.r = 1 LEFT JOIN n ON n.intent_id = i.id ORDER BY i.last_seen DESC NULLS LAST, i.frequency DESC, i.id LIMIT 200""",
    "intent_stats": "SELECT id, frequency, last_seen FROM (SELECT DISTINCT id, frequency, CAST(last_seen AS TIMESTAMP) AS last_seen FROM intent) x ORDER BY frequency DESC, last_seen DESC NULLS LAST, id LIMIT 25",
    "salience_decay": """
WITH u AS (SELECT user_id, count(*) AS hits, max(event_id) AS newest FROM events GROUP BY user_id), m AS (SELECT max(event_id) AS top FROM events)
SELECT user_id, round(0.5 * exp(-0.001 * (top - newest)) + 0.2 * ln(1.0 + hits), 6) AS salience FROM u JOIN m ON true""",
    "cluster_centroids": """
SELECT label, count(*) AS n, round(avg(cast(embedding[1] AS DOUBLE)), 6) AS y, round(avg(cast(embedding[2] AS DOUBLE)), 6) AS z FROM embeddings GROUP BY label HAVING count(*) > 0""",
    "minmax_scores": """
SELECT vec_id, label, CASE WHEN hi = lo THEN 1.0 ELSE round((s - lo) / (hi - lo), 6) END AS score FROM (
  SELECT vec_id, label, s, min(s) OVER (PARTITION BY label) AS lo, max(s) OVER (PARTITION BY label) AS hi FROM (SELECT vec_id, label, cast(embedding[1] AS DOUBLE) AS s FROM embeddings) a) b""",
    "star_join": """
SELECT n.n_name, r.r_name, count(*) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY n.n_name, r.r_name""",
    "semi_join": "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) GROUP BY c_mktsegment",
    "anti_join": "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment",
    "cube_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup_items": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber))",
    "window_frames": """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders""",
    "set_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49",
    "range_join": """
SELECT p_brand, count(*) AS n FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_extendedprice BETWEEN p.p_retailprice * 10 AND p.p_retailprice * 20 GROUP BY p_brand""",
    "lateral_top": """
SELECT s.s_suppkey, t.l_orderkey, t.l_extendedprice FROM supplier s JOIN (
  SELECT l_suppkey, l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) t ON t.l_suppkey = s.s_suppkey WHERE t.r = 1""",
}

_FILLER = ", ".join(f"'{w}'" for w in T.FILLER)


def _intent_terms(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '(?s)```.*?```|`[^`]*`', ' ', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_FILLER}))"
    )


_MACHINE = (
    r"^\s*(\[SYSTEM NOTIFICATION|# AGENTS\.md instructions|<(task-notification|system-reminder|local-command-stdout|command-name|command-message"
    r"|recommended_plugins|environment_context|user_instructions|permissions instructions)\b)"
)
#: Messages with lower-case sessions and the roles that their spellings resolve to.
_MESSAGES = """al AS (SELECT DISTINCT lower(trim(alias)) AS alias, lower(trim(role)) AS r FROM role_alias),
msg AS (SELECT m.id, lower(m.session_id) AS session_id, m.seq, m.text, m.created_at, coalesce(al.r, lower(trim(m.role))) AS role FROM message m LEFT JOIN al ON al.alias = lower(trim(m.role)))"""
_USER = f"role = 'user' AND text IS NOT NULL AND regexp_matches(text, '[^ \\t\\r\\n]') AND NOT regexp_matches(text, '{_MACHINE}')"
_CURRENT = """cur AS (SELECT * FROM kb_document QUALIFY row_number() OVER (PARTITION BY project_id, source_id, rel_path ORDER BY created_at DESC NULLS LAST) = 1)"""
_OLD = """old AS (SELECT * FROM kb_document WHERE created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY project_id, source_id, rel_path ORDER BY created_at DESC) = 1)"""
_WORDS = "unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) AS term"
_SQUEEZE = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))"
_TOKENS = "greatest(1, floor(length(text) / 4 + 0.5))::BIGINT"

_LEGS = f"""
q AS (SELECT subject AS query_id, {_WORDS.format(t="description")} FROM subject_area), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
d AS (SELECT doc_id, coalesce(project, '') AS project, {_WORDS.format(t="text")} FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, project, term, count(*) AS tf FROM d GROUP BY ALL), sizes AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sp AS (SELECT query_id, doc_id, project, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS sparse
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id) CROSS JOIN whole GROUP BY ALL),
slot AS (SELECT doc_id, project, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64) AS slot, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN tf ELSE -tf END) AS x FROM tf GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS dn FROM slot GROUP BY 1),
qs AS (SELECT query_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64) AS slot, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN qtf ELSE -qtf END) AS y FROM qt GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(y * y)) AS qn FROM qs GROUP BY 1),
de AS (SELECT query_id, doc_id, project, round(s / dn / qn, 6) AS dense FROM (SELECT query_id, doc_id, project, sum(x * y) AS s FROM slot JOIN qs USING (slot) GROUP BY ALL) JOIN dn USING (doc_id) JOIN qn USING (query_id) WHERE s > 0)"""


def _fused(by: str, k: int) -> str:
    return f"""
WITH {_LEGS},
dl AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dense DESC, doc_id) AS r FROM de QUALIFY r <= {k}),
sl AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sparse DESC, doc_id) AS r FROM sp QUALIFY r <= {k}),
f AS (SELECT coalesce(dl.query_id, sl.query_id) AS query_id, coalesce(dl.doc_id, sl.doc_id) AS doc_id, coalesce(dl.project, sl.project) AS project, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse,
  round(coalesce(1 / (60 + dl.r), 0) + coalesce(1 / (60 + sl.r), 0), 9) AS rrf FROM dl FULL JOIN sl ON dl.query_id = sl.query_id AND dl.doc_id = sl.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM f QUALIFY rank <= 8),
g AS (SELECT query_id, bool_or(rank <= 3 AND dense > 0 AND sparse > 0) AS agreement, max(CASE WHEN rank = 1 THEN dense END) AS best FROM t GROUP BY 1),
h AS (SELECT t.*, agreement, CASE WHEN best >= 0.55 OR best >= 0.4 AND agreement THEN 'high' WHEN best >= 0.4 OR agreement THEN 'medium' ELSE 'low' END AS tier FROM t JOIN g USING (query_id))"""


_REFS = (
    "list_distinct(list_filter(list_concat(list_transform(regexp_extract_all({t}, 'https?://[^\\s)<>\\]\"'']+'), lambda u: {{'kind': 'url', 'uri': trim(regexp_replace(u, '[.,);]+$', ''))}}), "
    "list_transform(list_concat(regexp_extract_all({t}, '\\b[0-9]{{1,5}}/[0-9]{{2,4}}\\b'), regexp_extract_all({t}, '\\b[A-Z]{{2,6}}\\s?[0-9]+(?::[0-9]+(?:\\.[0-9]+)*)?\\b'), regexp_extract_all({t}, '§\\s?[0-9]+[a-z]?')), "
    "lambda c: {{'kind': 'citation', 'uri': trim(c)}})), lambda r: r.uri <> '' AND length(r.uri) <= 2048))"
)
_EXT = "lower(regexp_extract({p}, '\\.([^./\\\\]*)$', 1))"
_in = lambda ws: ", ".join(f"'{w}'" for w in ws)
_DEF = T.DEFINITION.replace("(?![A-Za-z0-9_])", "\\b")
_GROUP = "row_number() OVER (PARTITION BY {by} ORDER BY {o})"

SQL = {
    "chunk_char_windows": """
SELECT doc_id, o::INT AS ordinal, (o * 1350)::INT AS start, length(w) AS n_chars, greatest(1, floor(length(w) / 4 + 0.5))::BIGINT AS tokens, sha256(w) AS hash FROM (
  SELECT doc_id, o, substring(text, o * 1350 + 1, 1500) AS w FROM (
    SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1500) / 1350.0))::BIGINT + 1)) AS o FROM documents WHERE text IS NOT NULL))""",
    "doc_content_dedup": f"SELECT sha256({_SQUEEZE}) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "hash_diff_changed": f"""
WITH {_CURRENT}, {_OLD}
SELECT c.id, CASE WHEN o.id IS NULL THEN 'new' ELSE 'changed' END AS state FROM cur c LEFT JOIN old o ON c.project_id = o.project_id AND c.source_id = o.source_id AND c.rel_path = o.rel_path
WHERE o.id IS NULL OR coalesce(o.content, '') <> coalesce(c.content, '')""",
    "doc_upsert_snapshot": f"WITH {_CURRENT} SELECT project_id, count(*) AS files, sum(length(coalesce(content, ''))) AS chars FROM cur GROUP BY 1",
    "vector_upsert": """
SELECT space_id, content_hash, token_count, CASE WHEN embedding IS NULL THEN 0 ELSE len(embedding) END AS dim FROM emb_minilm_384
QUALIFY row_number() OVER (PARTITION BY space_id, content_hash ORDER BY created_at DESC NULLS LAST, embedding_id DESC) = 1""",
    "message_append": "SELECT lower(session_id) AS session_id, count(DISTINCT seq) AS messages, max(seq) AS last_seq FROM message WHERE session_id IS NOT NULL AND seq IS NOT NULL AND created_at IS NOT NULL GROUP BY 1",
    "stream_tail": "SELECT lower(session_id) AS session_id, count(DISTINCT seq) AS messages, max(seq) AS last_seq FROM message WHERE session_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1",
    "unit_types": f"""
WITH {_CURRENT}, e AS (SELECT content, {_EXT.format(p="rel_path")} AS e FROM cur WHERE content IS NOT NULL), d AS (SELECT *, regexp_extract(content, '{_DEF}', 1) AS kw FROM e)
SELECT CASE WHEN e IN ({_in(T.MARKDOWN_FILES)}) THEN 'markdown' WHEN e IN ({_in(T.CODE_FILES)}) THEN 'code' ELSE 'text' END AS strategy,
  CASE WHEN e IN ({_in(T.MARKDOWN_UNITS)}) THEN CASE WHEN regexp_matches(content, '(?m)^#{{1,6}}\\s') THEN 'section' ELSE 'text' END
    WHEN e IN ({_in(T.CODE_UNITS)}) THEN CASE WHEN kw IN ({_in(T.SYMBOLS)}) THEN 'symbol' WHEN kw <> '' THEN 'definition' ELSE 'code' END ELSE 'text' END AS unit_type, count(*) AS files
FROM d GROUP BY ALL""",
    "doc_spine": """
SELECT doc_id, o AS a, o + 1 AS b FROM (SELECT doc_id, unnest(range(0, greatest(0, ceil((length(text) - 1500) / 1350.0))::BIGINT)) AS o FROM documents WHERE text IS NOT NULL)""",
    "dense_topk": f"""
SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, {_GROUP.format(by="a.vec_id", o="round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id")} AS rank
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 8""",
    "knn_links": f"""
WITH k AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  QUALIFY {_GROUP.format(by="a.vec_id", o="round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id")} <= 3)
SELECT least(q, id) AS a, greatest(q, id) AS b, max(floor(c * 1e4 + 0.5) / 1e4) AS weight FROM k GROUP BY 1, 2""",
    "sparse_topk": f"WITH {_LEGS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, doc_id) AS rank, doc_id, sparse FROM sp QUALIFY rank <= 8",
    "hybrid_search": _fused("query_id", 32) + " SELECT query_id, rank, doc_id, dense, sparse, rrf, agreement, tier FROM h",
    "hybrid_search_global": _fused("query_id, project", 16) + " SELECT query_id, rank, project, doc_id, dense, sparse, rrf, tier FROM h",
    "signal_summary": _fused("query_id", 32)
    + " SELECT query_id, count(*) FILTER (dense > 0) AS dense, count(*) FILTER (sparse > 0) AS lexical, count(*) FILTER (dense > 0 AND sparse > 0) AS both, count(*) AS total FROM h GROUP BY 1",
    "extract_refs": f"WITH {_CURRENT} SELECT r.kind AS kind, r.uri AS uri, count(DISTINCT id) AS files FROM (SELECT id, unnest({_REFS.format(t='content')}) AS r FROM cur WHERE content IS NOT NULL) GROUP BY ALL",
    "citation_verdicts": f"""
WITH {_CURRENT}, c AS (SELECT DISTINCT r.kind AS kind, r.uri AS uri, id FROM (SELECT id, unnest({_REFS.format(t="content")}) AS r FROM cur WHERE content IS NOT NULL)),
t AS (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT lower(concat_ws(' ', url, title)) FROM kb_document),
v AS (SELECT uri, bool_or(contains(t, lower(uri))) AS ok FROM (SELECT DISTINCT uri FROM c) u, t GROUP BY 1)
SELECT kind, count(*) FILTER (ok) AS verified, count(*) FILTER (NOT ok) AS unverified FROM c JOIN v USING (uri) GROUP BY 1""",
    "claim_support": """
WITH i AS (SELECT DISTINCT id, list_distinct(regexp_extract_all(lower(coalesce(intent_text, '')), '[0-9]+(?:[/:.\\-][0-9]+)+|[A-Za-z0-9_]+')) AS c FROM intent),
s AS (SELECT i.id AS intent_id, r.id AS rid, CASE WHEN len(c) > 0 THEN len(list_intersect(c, list_distinct(regexp_extract_all(lower(response_excerpt), '[0-9]+(?:[/:.\\-][0-9]+)+|[A-Za-z0-9_]+')))) / len(c) ELSE 0 END AS score
  FROM i JOIN intent_resolution r ON r.intent_id = i.id WHERE response_excerpt IS NOT NULL)
SELECT intent_id, floor(score * 1000 + 0.5) / 1000 AS score, score >= 0.3 AS supported, CASE WHEN score > 0 THEN rid ELSE -1 END AS answer FROM s
QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY score DESC, rid) = 1""",
    "budget_assembly": f"""
WITH once AS (SELECT project, doc_id, ingested_at, text FROM documents WHERE text IS NOT NULL AND project IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project, {_SQUEEZE} ORDER BY ingested_at DESC NULLS LAST, doc_id) = 1)
SELECT project, row_number() OVER w AS r, doc_id, sum({_TOKENS}) OVER w AS used FROM once WINDOW w AS (PARTITION BY project ORDER BY ingested_at DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) QUALIFY used <= 2000 OR r = 1""",
    "query_intents": f"""
WITH k AS (SELECT coalesce(regexp_matches(intent_text, '(?i)\\b(?:{T.SCOPED})\\b'), false) AS own, coalesce(regexp_matches(intent_text, '(?i)\\b(?:{T.SHARED})\\b'), false) AS common FROM intent),
n AS (SELECT CASE WHEN own AND NOT common THEN 'scoped' WHEN common AND NOT own THEN 'shared' ELSE 'balanced' END AS intent FROM k)
SELECT intent, CASE intent WHEN 'scoped' THEN 0.8 WHEN 'shared' THEN 0.2 ELSE 0.5 END AS scoped, CASE intent WHEN 'scoped' THEN 0.2 WHEN 'shared' THEN 0.8 ELSE 0.5 END AS shared, count(*) AS n FROM n GROUP BY 1""",
    "intent_normalized": f"""
WITH {_MESSAGES}, t AS (SELECT array_to_string({_intent_terms("text")}, ' ') AS normalized, created_at FROM msg WHERE {_USER})
SELECT 'i' || substr(sha256(normalized), 1, 30) AS id, normalized, count(*) AS frequency, min(created_at)::TIMESTAMP AS first_seen, max(created_at)::TIMESTAMP AS last_seen FROM t WHERE normalized <> '' GROUP BY normalized""",
    "intent_recall": f"""
WITH i AS (SELECT id, any_value(list_distinct({_intent_terms("intent_text")})) AS s FROM intent GROUP BY id),
p AS (SELECT a.id AS query_id, b.id AS id, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS raw FROM i a JOIN i b ON a.id <> b.id
  WHERE ('0x' || right(a.id, 2))::INT % 50 = 0 AND len(a.s) > 0 AND len(b.s) > 0)
SELECT query_id, id, floor(raw * 1000 + 0.5) / 1000 AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM p WHERE raw >= 0.45 QUALIFY rank <= 5""",
    "intent_grades": f"""
WITH {_MESSAGES}, t AS (SELECT * FROM msg WHERE {_USER} AND session_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
n AS (SELECT text, lead(text) OVER (PARTITION BY session_id ORDER BY seq) AS nx FROM t),
s AS (SELECT nx, list_distinct({_intent_terms("text")}) AS a, list_distinct({_intent_terms("nx")}) AS b FROM n WHERE nx IS NOT NULL),
g AS (SELECT CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS sim,
  regexp_matches(nx, '(?i)\\b(?:{T.ACCEPT})\\b') AS yes, regexp_matches(nx, '(?i)\\b(?:{T.REJECT.replace("'", "''")})\\b') AS no FROM s)
SELECT CASE WHEN no OR sim >= 0.6 AND NOT yes THEN 'unresolved' WHEN sim >= 0.35 AND NOT yes THEN 'partial' ELSE 'resolved' END AS outcome,
  CASE WHEN no OR sim >= 0.6 AND NOT yes THEN floor(greatest(0, 0.3 - sim * 0.3) * 1000 + 0.5) / 1000 WHEN sim >= 0.35 AND NOT yes THEN 0.5 WHEN yes THEN 0.9 ELSE 0.7 END AS score, count(*) AS turns FROM g GROUP BY ALL""",
    "intent_retention": """
WITH o AS (SELECT * FROM intent_resolution WHERE intent_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST) = 1)
SELECT intent_id, id, score FROM o QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY score DESC NULLS LAST, id DESC) <= 12 OR row_number() OVER (PARTITION BY intent_id ORDER BY id DESC) = 1""",
    "bundled_positions": """
WITH p AS (SELECT vec_id AS id, label, vec_id % 4 AS s, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT id, round(x * 0.42 + avg(x) OVER d * 0.42 + avg(x) OVER e * 0.16, 6) AS x, round(y * 0.42 + avg(y) OVER d * 0.42 + avg(y) OVER e * 0.16, 6) AS y, round(z * 0.42 + avg(z) OVER d * 0.42 + avg(z) OVER e * 0.16, 6) AS z
FROM p WINDOW d AS (PARTITION BY label), e AS (PARTITION BY s)""",
    "spiral_layout": """
WITH g AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
r AS (SELECT *, greatest(7, 3 * sqrt(n) * 1.6) AS q, 1 - 2 * i / (n - 1) AS u, pi() * (3 - sqrt(5)) * i AS a FROM g)
SELECT label, round(cos(a) * sqrt(greatest(0, 1 - u * u)) * q, 4) + 0.0 AS x, round(u * 0.55 * q, 4) + 0.0 AS y, round(sin(a) * sqrt(greatest(0, 1 - u * u)) * q, 4) + 0.0 AS z FROM r""",
    "event_windows_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_windows_sliding": """
SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2""",
    "event_windows_session": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""",
    "asof_orders": """
WITH b AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders), l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, before, coalesce(lines, 0) AS lines FROM b LEFT JOIN l ON l_orderkey = o_orderkey WHERE before IS NOT NULL""",
}
SQL["node_degree"] = f"WITH l AS ({SQL['knn_links']}) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM l UNION ALL SELECT b FROM l) GROUP BY 1"
