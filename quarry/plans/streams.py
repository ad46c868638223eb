"""Registered queries that write files as the sources find them and read them back: transcripts, histories, folder trees, event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.memory import resolved
from quarry.plans import oracle
from quarry.session import scratch, table
from quarry.sources.files import scan_files
from quarry.sources.transcripts import history_messages, read_history, read_transcripts
from quarry.streaming import tail

Query = Callable[[SparkSession, str], DataFrame]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolved(table(spark, sf_dir, "message"), table(spark, sf_dir, "role_alias"))
    return rows.where("session_id is not null and seq is not null and text is not null").select("session_id", "seq", "role", "text").distinct()


def transcript_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as documents of messages, one to a line file, and read back: turns and characters per role."""
    path = scratch(spark, "transcripts")
    said = F.struct(F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")).alias("type"), F.col("text").alias("content"))
    per = _turns(spark, sf_dir).groupBy(F.pmod(F.xxhash64("session_id"), F.lit(16)).alias("file")).agg(F.array_sort(F.collect_list(F.struct("session_id", "seq", said.alias("m")))).alias("ms"))
    docs = per.select("file", F.to_json(F.struct(F.transform("ms", lambda m: m["m"]).alias("messages"))).alias("value"))
    docs.write.partitionBy("file").text(path)
    return read_transcripts(spark, f"{path}/file=*").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as transcripts of plain lines, with broken lines between, and read back: turns and characters per role."""
    path = scratch(spark, "transcripts")
    rows = _turns(spark, sf_dir).withColumn("file", F.pmod(F.xxhash64("session_id"), F.lit(16)))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content")))
    rows.select("file", F.explode(F.array(plain, F.lit('{"type": "user", "content'), F.lit("[]"))).alias("value")).write.partitionBy("file").text(path)
    return read_transcripts(spark, f"{path}/file=*").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns written as a prompt history and read back as messages of one session: prompts per project."""
    path = scratch(spark, "history")
    users = resolved(table(spark, sf_dir, "message"), table(spark, sf_dir, "role_alias")).where("role = 'user' and text is not null")
    homes = table(spark, sf_dir, "kb_project").select(F.col("id").alias("project_id"), "root_path")
    rows = users.join(F.broadcast(homes), "project_id", "left")
    line = F.to_json(F.struct(F.col("text").alias("display"), F.col("root_path").alias("project"), F.unix_millis("created_at").alias("timestamp")))
    rows.select(line.alias("value")).write.text(path)
    back = history_messages(read_history(spark, path), table(spark, sf_dir, "kb_project"))
    return back.groupBy("project_id").agg(F.count("*").alias("prompts"), F.sum(F.length("text")).alias("chars"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written to a folder per language and scanned by globs and ignore rules: files' characters per folder."""
    path = scratch(spark, "tree")
    table(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text").write.partitionBy("lang").text(path)
    files = scan_files(spark, path, ["lang=*/*.txt"], ["lang=es/", "*.crc"])
    folder = F.regexp_extract("rel_path", "lang=([^/]*)/", 1)
    return files.groupBy(folder.alias("lang")).agg(F.sum(F.length("content")).alias("chars"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the events as a stream gives them: those that the watermark, an hour behind the last event, has passed."""
    schema = table(spark, sf_dir, "events").schema
    return tail.windowed(spark, f"{sf_dir}/events.parquet*", schema)


def queries() -> dict[str, Query]:
    return {
        "transcript_documents": transcript_documents,
        "transcript_lines": transcript_lines,
        "prompt_history": prompt_history,
        "scanned_files": scanned_files,
        "stream_windows": stream_windows,
    }


_VISIBLE = "[^\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_T = f"WITH {oracle._MESSAGES}, t AS (SELECT DISTINCT session_id, seq, role, text FROM msg WHERE session_id IS NOT NULL AND seq IS NOT NULL AND regexp_matches(text, '{_VISIBLE}'))"

SQL = {
    "transcript_documents": f"{_T} SELECT role, count(*) AS turns, sum(length(replace(text, chr(0), ''))) AS chars FROM t WHERE role IN ('user', 'assistant') GROUP BY 1",
    "transcript_lines": f"{_T} SELECT role, count(*) AS turns, sum(length(replace(text, chr(0), ''))) AS chars FROM t WHERE role IN ('user', 'assistant', 'tool') GROUP BY 1",
    "prompt_history": f"""
WITH {oracle._MESSAGES}, u AS (SELECT trim(text, ' ') AS text, k.id AS project_id FROM message m LEFT JOIN al ON al.alias = lower(trim(m.role)) LEFT JOIN kb_project k ON k.id = m.project_id AND root_path IS NOT NULL
  WHERE coalesce(al.r, lower(trim(m.role))) = 'user' AND text IS NOT NULL)
SELECT project_id, count(*) AS prompts, sum(length(text)) AS chars FROM u WHERE text <> '' AND text NOT LIKE '/%' AND NOT regexp_matches(text, '{oracle._MACHINE}') GROUP BY 1""",
    "stream_windows": """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "scanned_files": "SELECT coalesce(lang, 'none') AS lang, sum(length(replace(text, chr(0), '')) + 1) AS chars FROM documents WHERE text IS NOT NULL AND coalesce(lang, 'none') <> 'es' GROUP BY 1",
}
