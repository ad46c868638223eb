"""Chat transcripts in three formats, and prompt histories."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.memory import MACHINE


@F.pandas_udf(T.StringType())
def _flat(contents: pd.Series) -> pd.Series:
    """Text of a content of blocks nested to any depth, of which text goes before content."""

    def walk(x) -> str:
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return "\n".join(t for t in map(walk, x) if t)
        if isinstance(x, dict):
            return walk(x["text"] if x.get("text") is not None else x.get("content"))
        return "" if x is None else str(x)

    def one(content: str | None) -> str | None:
        try:
            return walk(json.loads(content)) if content is not None else None
        except ValueError:
            return content

    return pd.Series([one(c) for c in contents], dtype=object)


def _text(v: Column, path: str) -> Column:
    """Text at the path. Plain strings stay in the JVM; only blocks go through Python."""
    content = F.try_variant_get(v, path, "variant")
    plain = F.schema_of_variant(content) == "STRING"
    blocks = _flat(F.when(~plain, F.to_json(content)))
    return F.replace(F.when(plain, F.try_variant_get(v, path, "string")).otherwise(blocks), F.lit("\0"), F.lit(""))


#: A character that is no white space, of any script.
VISIBLE = "(?U)[^\\s\\x{FEFF}]"


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(path, at, role, text) of transcript lines (path, at, line), wrapped or plain; lines that are blank, malformed or no
    object, that have another role, or no text, are left out."""
    lines = lines.withColumn("v", F.try_parse_json("line"))
    wrapped = _string(F.col("v"), "$.payload.type").isNotNull()
    kind = F.when(wrapped, F.when(_string(F.col("v"), "$.payload.type") == "message", _string(F.col("v"), "$.payload.role"))).otherwise(
        F.coalesce(_string(F.col("v"), "$.message.role"), _string(F.col("v"), "$.type"))
    )
    text = F.when(wrapped, _text(F.col("v"), "$.payload.content")).otherwise(F.coalesce(_text(F.col("v"), "$.message.content"), _text(F.col("v"), "$.content")))
    turns = lines.where("v is not null").select("path", "at", kind.alias("role"), text.alias("text"), wrapped.alias("w"))
    return turns.where("role in ('user', 'assistant') or (role = 'tool' and not w)").where(F.col("text").rlike(VISIBLE)).drop("w")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, role, text) of the transcripts below a path or glob.

    A file whose first non-blank line does not parse alone, or has messages, is one document; others are lines, of which
    blank, malformed and non-object ones are skipped. Lines are wrapped (payload of type message) or plain. Turns
    without text are left out; seq counts the turns of a file from 0.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    first = F.try_parse_json(F.regexp_extract("value", "(?m)^[ \\t]*(\\S.*)$", 1))
    whole = first.isNull() | F.try_variant_get(first, "$.messages", "variant").isNotNull()
    files = files.withColumn("whole", whole)
    docs = files.where("whole").select("path", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.messages", "array<variant>")).alias("at", "v"))
    role = F.when(_string(F.col("v"), "$.type") == "gemini", "assistant").otherwise(_string(F.col("v"), "$.type"))
    from_docs = docs.select("path", "at", role.alias("role"), _text(F.col("v"), "$.content").alias("text")).where("role in ('user', 'assistant')")
    lines = files.where("not whole").select("path", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    turns = from_docs.where(F.col("text").rlike(VISIBLE)).unionByName(parse_lines(lines))
    return turns.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).select("path", "seq", "role", "text")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text, project, at) of a prompt history: display texts, without blank ones, commands and machine text."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "json"))
    v = F.try_parse_json("json")
    out = rows.select("path", "line", F.trim(_string(v, "$.display")).alias("text"), _string(v, "$.project").alias("project"), F.timestamp_millis(F.try_variant_get(v, "$.timestamp", "bigint")).alias("at"))
    return out.where((F.col("text") != "") & ~F.col("text").startswith("/") & ~F.col("text").rlike(MACHINE))


def history_messages(history: DataFrame, projects: DataFrame, session: str = "history") -> DataFrame:
    """Rows of a prompt history as messages (session_id, seq, role, text, project_id, created_at) of one synthetic session.

    seq is the line; the project is the one whose root the prompt's path is; a prompt without a time has the present one.
    """
    roots = projects.where("root_path is not null").groupBy("root_path").agg(F.min("id").alias("project_id"))
    known = history.join(F.broadcast(roots), F.col("project") == F.col("root_path"), "left")  # projects are few: their table is fixed
    return known.select(F.lit(session).alias("session_id"), F.col("line").alias("seq"), F.lit("user").alias("role"), "text", "project_id", F.coalesce("at", F.current_timestamp()).alias("created_at"))
