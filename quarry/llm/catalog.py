"""The registered queries of the training-data operators, and comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import conversations, mixing, neighbours, packing, pairs, splitting, subjects, syntax
from quarry.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(splitting.found, "kb_document", "kb_project"),
        "p1_pieces": _over(splitting.pieces, "kb_document", "kb_project"),
        "p2_found": _over(pairs.found, "intent_resolution", "intent", "documents"),
        "p3_found": conversations.found,
        "p3_conversations": conversations.conversations,
        "p4_found": _over(syntax.found, "kb_document"),
        "p4_rates": _over(syntax.rates, "kb_document"),
        "p5_found": _over(neighbours.found, "emb_minilm_384"),
        "p5_nearest": _over(neighbours.nearest, "emb_minilm_384"),
        "p6_found": _over(packing.found, "documents", "container_size"),
        "p6_assignments": _over(packing.assignments, "documents", "container_size"),
        "p6_fill": _over(packing.fill, "documents", "container_size"),
        "p7_found": _over(mixing.found, "documents", "mix_target"),
        "p7_selection": _over(lambda d, t: mixing.documents_mix(d, t)[0], "documents", "mix_target"),
        "p7_report": _over(mixing.report, "documents", "mix_target"),
        "p8_found": _over(subjects.found, "documents", "subject_area", "subject_label"),
        "p8_composition": _over(subjects.composition, "documents", "subject_area", "subject_label"),
    }


_CURRENT = """
WITH cur AS (
  SELECT id, project_id, content FROM kb_document
  QUALIFY row_number() OVER (PARTITION BY project_id, source_id, rel_path ORDER BY created_at DESC NULLS LAST) = 1
)"""

_TOKENS = "coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\r\\n]')), 0)"

_P1 = (
    _CURRENT
    + """, cfg AS (
  SELECT id AS project_id, coalesce(nullif(greatest(try_cast(json_extract_string(chunk_cfg, '$.max_chars') AS INT), 0), 0), 1500) AS m FROM kb_project
), big AS (
  SELECT id, content, coalesce(m, 1500) AS m FROM cur LEFT JOIN cfg USING (project_id) WHERE length(content) > coalesce(m, 1500)
)
SELECT id AS document_id,
  CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[ \\t\\r\\n]'), lambda x: length(x))) > m THEN 'forced' ELSE 'natural' END AS cut
FROM big"""
)

#: White space and zero-width characters; what is left of a text without them is visible.
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
_MACHINE = (
    r"^[\s\x{FEFF}\x{A0}]*(\[SYSTEM NOTIFICATION|# AGENTS\.md instructions|<(task-notification|system-reminder|local-command-stdout|command-name"
    r"|command-message|recommended_plugins|environment_context|user_instructions|permissions instructions)\b)"
)

_P3 = rf"""
WITH alias AS (SELECT DISTINCT lower(trim(alias)) AS alias, role FROM role_alias),
rows AS (
  SELECT DISTINCT lower(session_id) AS s, seq, a.role AS role,
    regexp_replace(coalesce(text, ''), '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g') AS t
  FROM message m LEFT JOIN alias a ON lower(trim(m.role)) = a.alias WHERE session_id IS NOT NULL
), marked AS (
  SELECT *, regexp_replace(t, '{_BLANK}', '', 'g') <> '' AS vis, regexp_matches(t, '{_MACHINE}') AS machine FROM rows
), left_in AS (
  SELECT s, seq, CASE WHEN role = 'user' THEN 'U' WHEN vis THEN 'A' ELSE 'a' END AS k, vis FROM marked
  WHERE role = 'assistant' OR (role = 'user' AND vis AND NOT machine)
), shape AS (SELECT s, string_agg(k, '' ORDER BY seq) AS shape, bool_or(vis) AS vis FROM left_in GROUP BY s),
base AS (
  SELECT s, bool_or(seq IS NULL OR role IS NULL) OR count(*) <> count(DISTINCT seq) OR min(seq) <> 0 OR max(seq) + 1 <> count(*) AS broken FROM rows GROUP BY s
), ids AS (SELECT lower(id) AS s FROM chat_session WHERE id IS NOT NULL UNION SELECT s FROM base)
SELECT s AS session_id FROM ids LEFT JOIN base USING (s) LEFT JOIN shape USING (s)
WHERE broken IS NULL OR broken OR NOT coalesce(vis, false) OR regexp_matches(coalesce(shape, ''), 'Ua+U|Ua*$')"""

#: The turns of the sessions that are not dropped.
_P3_TURNS = f"""
WITH dropped AS ({_P3}), alias AS (SELECT DISTINCT lower(trim(alias)) AS alias, role FROM role_alias)
SELECT DISTINCT lower(session_id) AS session_id, seq AS turn, a.role AS role,
  regexp_replace(coalesce(text, ''), '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g') AS text
FROM message m LEFT JOIN alias a ON lower(trim(m.role)) = a.alias WHERE session_id IS NOT NULL AND lower(session_id) NOT IN (SELECT session_id FROM dropped)"""

_P5 = """
WITH v AS (
  SELECT embedding_id AS id, any_value(embedding::DOUBLE[]) AS e FROM emb_minilm_384
  WHERE embedding IS NOT NULL AND len(embedding) = 384 AND list_count(embedding) = 384
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1
), s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
top AS (SELECT x, y, c FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 10)
SELECT DISTINCT least(x, y) AS a_id, greatest(x, y) AS b_id FROM top WHERE c >= 0.9"""

_P6 = f"""
SELECT DISTINCT container_id, doc_id FROM (SELECT doc_id, {_TOKENS} AS n FROM documents) d JOIN container_size c ON d.n > c.capacity"""

_P7 = f"""
WITH d AS (SELECT lower(trim(source)) AS k, {_TOKENS} AS n FROM documents),
per AS (SELECT k, sum(n) AS n FROM d GROUP BY k), whole AS (SELECT sum(n) AS n FROM d)
SELECT mix_id, source FROM mix_target t LEFT JOIN per ON lower(trim(t.source)) = per.k CROSS JOIN whole
WHERE coalesce(per.n, 0) * max_repeat < weight * total_share * whole.n"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p3_found": _P3, "p3_conversations": _P3_TURNS, "p5_found": _P5, "p6_found": _P6, "p7_found": _P7}
