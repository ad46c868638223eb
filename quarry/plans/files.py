"""Registered queries over files, their references and labels, transcripts and graphs of groups; with comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph
from quarry.operators.memory import MACHINE, resolved
from quarry.operators.snapshot import beside, latest
from quarry.plans import oracle
from quarry.session import table
from quarry.sources.files import selected
from quarry.sources.transcripts import parse_lines

Query = Callable[[SparkSession, str], DataFrame]

GLOBS = ["**/*.{py,ts,go}", "docs/**"]
RULES = ["# build output", "tests/", "*.txt", "!docs/*.txt", "amber_*"]


def _over(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])


def _current(docs: DataFrame) -> DataFrame:
    return latest(docs, ["project_id", "source_id", "rel_path"], "created_at", [F.xxhash64("content"), "id"])


def source_scan(docs: DataFrame) -> DataFrame:
    """The files that the globs choose and the ignore rules leave, each path once in its source."""
    return docs.where(selected(F.col("rel_path"), GLOBS, RULES)).select("project_id", "source_id", "rel_path").distinct()


def import_links(docs: DataFrame) -> DataFrame:
    """(document_id, uri): the modules that each current file imports."""
    return _current(docs).select(F.col("id").alias("document_id"), F.explode(T.imports(F.col("content"), F.col("rel_path"))).alias("uri"))


def reference_catalog(docs: DataFrame) -> DataFrame:
    """(kind, uri, files, first_seen, last_seen): modules and references of all states of the files, in microseconds since 1970."""
    links = docs.select("id", "created_at", F.explode(T.imports(F.col("content"), F.col("rel_path"))).alias("uri")).withColumn("kind", F.lit("module"))
    refs = docs.select("id", "created_at", F.explode(T.references(F.col("content"))).alias("r")).select("id", "created_at", "r.uri", "r.kind")
    seen = F.unix_micros("created_at")
    return links.unionByName(refs).groupBy("kind", "uri").agg(F.countDistinct("id").alias("files"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def document_detail(docs: DataFrame) -> DataFrame:
    """Each current file with its number of windows, distinct references and modules."""
    n = F.length(F.col("content"))
    windows = F.when(F.col("content").isNull(), 0).otherwise(F.greatest(F.lit(0), F.ceil((n - 1500) / 1350)) + 1)
    out = _current(docs).select("id", windows.alias("windows"), F.size(T.references(F.col("content"))).alias("refs"), F.size(T.imports(F.col("content"), F.col("rel_path"))).alias("modules"))
    return out.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("windows", "refs", "modules")])


def document_cards(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """Each current file's label, address (its own or built from the project's root), age on 2026-02-01, and colour of its project."""
    now = F.timestamp_seconds(F.lit(1769904000))
    rows = _current(docs).join(projects.select(F.col("id").alias("project_id"), "name", "root_path").dropDuplicates(["project_id"]), "project_id", "left")
    url = F.coalesce("url", T.build_url(F.col("root_path"), F.col("rel_path")))
    return rows.select("id", T.descriptor(F.col("title"), F.col("rel_path")).alias("label"), url.alias("url"), T.relative_age(F.col("created_at"), now).alias("age"), T.hue(F.col("name")).alias("hue"))


def nearest_project(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each file's full path by its nearest ancestor that is a project's root; files of each project and root found."""
    roots = projects.where("root_path is not null").select(F.col("root_path").alias("folder"), "name")
    homes = projects.select(F.col("id").alias("project_id"), "root_path")
    path = docs.join(homes, "project_id").where("root_path is not null").select("id", F.concat_ws("/", "root_path", "rel_path").alias("path")).distinct()
    parts = F.split("path", "/")
    up = path.select("id", "path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select("id", "path", "depth", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/").alias("folder"))
    best = up.join(roots, "folder").groupBy("id", "path").agg(F.max(F.struct("depth", "name")).alias("b"))
    return best.groupBy(F.col("b.name").alias("project"), F.col("b.depth").alias("depth")).agg(F.count("*").alias("files"))


def transcript_messages(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Messages written as lines of transcripts, plain and wrapped by turns, and read back: turns and characters per role."""
    messages = resolved(messages, aliases)
    role, body = F.col("role"), F.col("text")
    blocks = F.to_json(F.struct(F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(role.alias("type"), body.alias("content")))
    wrapped = F.to_json(F.struct(F.struct(F.lit("message").alias("type"), role.alias("role"), body.alias("content")).alias("payload")))
    line = F.when(F.col("seq") % 3 == 0, blocks).when(F.col("seq") % 3 == 1, plain).otherwise(wrapped)
    turns = parse_lines(messages.where("session_id is not null and seq is not null").select(F.col("session_id").alias("path"), F.col("seq").alias("at"), line.alias("line")))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def prompt_pairs(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(session_id, seq, previous): each user turn that no program wrote, with the one before it in its session."""
    own = resolved(messages, aliases).where("session_id is not null and seq is not null and text is not null").where((F.col("role") == "user") & ~F.col("text").rlike(MACHINE))
    once = own.select("session_id", "seq").distinct()
    return beside(once, "session_id", "seq", ["seq"], ahead=False).select("session_id", "seq", F.col("__beside.seq").alias("previous")).where("previous is not null")


def node_sample(rows: DataFrame) -> DataFrame:
    return graph.sampled(rows.select("label", "vec_id"), "label", "vec_id", 40)


def project_graphs(rows: DataFrame) -> DataFrame:
    placed = graph.group_graphs(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vec")))
    return placed.select("group", "id", "x", "y", "z", F.to_json("links").alias("links"))


def queries() -> dict[str, Query]:
    return {
        "source_scan": _over(source_scan, "kb_document"),
        "import_links": _over(import_links, "kb_document"),
        "reference_catalog": _over(reference_catalog, "kb_document"),
        "document_detail": _over(document_detail, "kb_document"),
        "document_cards": _over(document_cards, "kb_document", "kb_project"),
        "nearest_project": _over(nearest_project, "kb_document", "kb_project"),
        "transcript_messages": _over(transcript_messages, "message", "role_alias"),
        "prompt_pairs": _over(prompt_pairs, "message", "role_alias"),
        "node_sample": _over(node_sample, "embeddings"),
        "project_graphs": _over(project_graphs, "embeddings"),
    }


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SCRIPT = " || ".join(f"regexp_extract_all(coalesce(content, ''), {_q(p)}, 1)" for p in T.SCRIPT_IMPORTS)
_GO = f"regexp_extract_all(array_to_string(regexp_extract_all(coalesce(content, ''), {_q(T.GO_BLOCK)}, 1), chr(10)), {_q(T.GO_NAME)}, 1) || regexp_extract_all(coalesce(content, ''), {_q(T.GO_IMPORT)}, 1)"
_EXT = oracle._EXT.format(p="rel_path")
_IMPORTS = f"list_distinct(CASE WHEN {_EXT} IN ({', '.join(map(_q, T.SCRIPT_FILES))}) THEN {_SCRIPT} WHEN {_EXT} = 'go' THEN {_GO} ELSE []::VARCHAR[] END)"
_REFS = oracle._REFS.format(t="content")
_NOW = "1769904000000000"
_AGE = f"(({_NOW} - epoch_us(created_at)) / 1000000.0)"

SQL = {
    "source_scan": r"""
SELECT DISTINCT project_id, source_id, rel_path FROM kb_document
WHERE (regexp_matches(rel_path, '\.(py|ts|go)$') OR rel_path LIKE 'docs/%') AND NOT list_contains(string_split(rel_path, '/'), '.git')
  AND NOT regexp_matches(rel_path, '(^|/)amber_') AND (regexp_matches(rel_path, '^docs/[^/]*\.txt(/|$)') OR NOT regexp_matches(rel_path, '(^|/)tests/|\.txt(/|$)'))""",
    "import_links": f"WITH {oracle._CURRENT} SELECT id AS document_id, unnest({_IMPORTS}) AS uri FROM cur",
    "reference_catalog": f"""
WITH u AS (SELECT id, created_at, 'module' AS kind, unnest({_IMPORTS}) AS uri FROM kb_document
  UNION ALL SELECT id, created_at, r.kind, r.uri FROM (SELECT id, created_at, unnest({_REFS}) AS r FROM kb_document WHERE content IS NOT NULL) x)
SELECT kind, uri, count(DISTINCT id) AS files, min(epoch_us(created_at)) AS first_seen, max(epoch_us(created_at)) AS last_seen FROM u GROUP BY kind, uri""",
    "document_detail": f"""
WITH {oracle._CURRENT}, r AS (SELECT id, count(*) AS n FROM (SELECT id, unnest({_REFS}) AS r FROM cur WHERE content IS NOT NULL) x GROUP BY id)
SELECT cur.id, CASE WHEN content IS NULL THEN 0 ELSE greatest(0, ceil((length(content) - 1500) / 1350)) + 1 END::BIGINT AS windows, coalesce(n, 0) AS refs, len({_IMPORTS}) AS modules
FROM cur LEFT JOIN r ON r.id = cur.id""",
    "document_cards": f"""
WITH {oracle._CURRENT}, t AS (SELECT cur.*, name, root_path, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE rel_path END AS b FROM cur LEFT JOIN kb_project p ON p.id = project_id),
l AS (SELECT *, coalesce(nullif(string_split(b, '/')[-1], ''), b) AS l FROM t)
SELECT id, CASE WHEN length(l) > 34 THEN substr(l, 1, 33) || '…' WHEN l <> '' THEN l ELSE '·' END AS label,
  coalesce(url, CASE WHEN root_path <> '' THEN regexp_replace(root_path, '/$', '') || '/' || rel_path END) AS url,
  CASE WHEN {_AGE} < 0 OR created_at IS NULL THEN '' WHEN {_AGE} < 90 THEN floor({_AGE} + 0.5)::BIGINT || 's' WHEN {_AGE} < 5400 THEN floor({_AGE} / 60 + 0.5)::BIGINT || 'm'
    WHEN {_AGE} < 129600 THEN floor({_AGE} / 3600 + 0.5)::BIGINT || 'h' ELSE floor({_AGE} / 86400 + 0.5)::BIGINT || 'd' END AS age,
  coalesce(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296), 0) % 360 AS hue FROM l""",
    "nearest_project": """
WITH f AS (SELECT DISTINCT d.id, root_path || '/' || rel_path AS path FROM kb_document d JOIN kb_project p ON p.id = d.project_id WHERE root_path IS NOT NULL),
m AS (SELECT f.id, path, name, len(string_split(root_path, '/')) AS depth FROM f JOIN kb_project p ON path = root_path OR starts_with(path, root_path || '/')),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY depth DESC, name DESC) = 1)
SELECT name AS project, depth, count(*) AS files FROM b GROUP BY ALL""",
    "transcript_messages": rf"""
WITH {oracle._MESSAGES}
SELECT role, count(*) AS turns, sum(length(text)) AS chars FROM msg
WHERE session_id IS NOT NULL AND seq IS NOT NULL AND regexp_matches(text, '[^\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]') AND (role IN ('user', 'assistant') OR (role = 'tool' AND seq % 3 <> 2)) GROUP BY 1""",
    "prompt_pairs": f"""
WITH {oracle._MESSAGES}, u AS (SELECT DISTINCT session_id, seq FROM msg
  WHERE session_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL AND role = 'user' AND NOT regexp_matches(text, '{oracle._MACHINE}'))
SELECT session_id, seq, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS previous FROM u QUALIFY previous IS NOT NULL""",
    "node_sample": "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id::VARCHAR), vec_id) <= 40",
}

SHARED = {
    "support_box": """
WITH c AS (SELECT label, avg(cast(embedding[1] AS DOUBLE)) AS cx, avg(cast(embedding[2] AS DOUBLE)) AS cy FROM embeddings GROUP BY label)
SELECT e.label, round(greatest(0.55, max(embedding[1] - cx)) + 0.2, 6) AS east, round(greatest(0.55, max(cx - embedding[1])) + 0.2, 6) AS west,
  round(greatest(0.55, max(embedding[2] - cy)) + 0.2, 6) AS north, round(greatest(0.55, max(cy - embedding[2])) + 0.2, 6) AS south
FROM embeddings e JOIN c ON c.label = e.label GROUP BY e.label""",
    "orphan_vectors": """
SELECT e.space_id, count(DISTINCT e.embedding_id) AS vectors FROM emb_minilm_384 e ANTI JOIN kb_document d ON e.content_hash = d.content_hash GROUP BY e.space_id""",
    "session_orphans": """
SELECT 'message' AS side, count(DISTINCT lower(m.session_id)) AS sessions FROM message m ANTI JOIN chat_session s ON lower(s.id) = lower(m.session_id) WHERE m.session_id IS NOT NULL
UNION ALL SELECT 'session', count(DISTINCT lower(s.id)) FROM chat_session s ANTI JOIN message m ON lower(s.id) = lower(m.session_id)""",
    "grade_summary": """
SELECT grader, lower(trim(outcome)) AS outcome, count(DISTINCT id) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most
FROM (SELECT DISTINCT id, grader, outcome, score FROM intent_resolution) x GROUP BY grader, lower(trim(outcome))""",
}
