"""Chunkers: windows of characters in closed form; lines and paragraphs packed by folds over their lengths; declarations.

All but Python's declarations, which need its parser, are expressions of the JVM.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarry.functions import text as T

MIN_CHARS, MAX_CHARS, OVERLAP = 200, 1500, 150
#: Characters that a carried line stands for.
LINE_CHARS = 40

# What declares a name at the left margin, by language.
_SCRIPT = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?(?:abstract[ \t]+)?(?:function\*?|class|interface|type|enum|const|let|var)"
_GO = r"(?:func(?:[ \t]*\([^)\n]*\))?|type)"


def char_windows(docs: DataFrame, key: str, content: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, start, text): windows of max_chars that step by max_chars - overlap; an empty text is one empty window, null none."""
    step = max(1, max_chars - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(content) - max_chars) / step)).cast("int")
    rows = docs.where(F.col(content).isNotNull()).select(key, content, F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    return rows.select(key, "ordinal", (F.col("ordinal") * step).alias("start"), F.substring(F.col(content), F.col("ordinal") * step + 1, F.lit(max_chars)).alias("text"))


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(units: Column, most: Column, carry: Column, glue: str) -> Column:
    """Array of texts: consecutive units (an array of texts) joined by the glue, as many as have `most` characters together.

    A unit that is larger stands alone. Each text but the first begins with up to `carry` units of the one before. Only
    where texts begin is folded; how long a run is follows from running sums of the lengths.
    """
    state = F.struct(F.lit(0).alias("first"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))
    sums = F.aggregate(units, F.struct(F.lit(0).alias("n"), F.array(F.lit(0)).alias("all")), lambda s, u: F.struct((s["n"] + F.length(u)).alias("n"), F.concat(s["all"], F.array(s["n"] + F.length(u))).alias("all")), lambda s: s["all"])

    def cut(p: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            full = (i > s["first"]) & (F.get(p, i + 1) - F.get(p, s["first"]) > most)
            here = F.struct(s["first"].alias("a"), i.alias("b"))
            return F.when(full, F.struct(F.greatest(s["first"], i - carry).alias("first"), F.concat(s["cuts"], F.array(here)).alias("cuts"))).otherwise(s)

        n = F.size(p) - 1
        done = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), state, step)
        return _let(done, lambda d: F.concat(d["cuts"], F.array(F.struct(d["first"].alias("a"), n.alias("b")))))

    return F.transform(_let(sums, cut), lambda c: F.array_join(F.slice(units, c["a"] + 1, c["b"] - c["a"]), glue))


def line_windows(text: Column, most: Column, overlap: Column) -> Column:
    """Windows of whole lines of at most `most` characters, line ends not counted; each carries the last lines of the one before."""
    return packed(F.split(text, "\n"), most, F.ceil(overlap / LINE_CHARS).cast("int"), "\n")


def sections(text: Column, most: Column) -> Column:
    """Array of (title, body) of markdown: a section per heading line, which stays in the body; the text before the first has
    no title. Sections over `most` are packed by paragraphs. Empty bodies are left out."""
    heading = "\\A#{1,6}[^\\S\\n]+([^\\n]*)"
    parts = F.transform(F.split(text, "(?md)(?=^#{1,6}[^\\S\\n])"), lambda p: F.struct(F.nullif(F.regexp_extract(p, heading, 1), F.lit("")).alias("t"), F.trim(F.regexp_replace(p, "\\A\\s+|\\s+\\z", "")).alias("b")))
    titled = lambda t, bodies: F.transform(bodies, lambda b: F.struct(F.trim(t).alias("title"), F.regexp_replace(b, "\\A\\s+|\\s+\\z", "").alias("body")))
    each = F.transform(parts, lambda p: titled(p["t"], F.when(F.length(p["b"]) > most, packed(F.split(p["b"], "\n{2,}"), most, F.lit(0), "\n\n")).otherwise(F.array(p["b"]))))
    return F.filter(F.flatten(each), lambda x: x["body"] != "")


@F.pandas_udf(S.ArrayType(S.StructType([S.StructField("name", S.StringType()), S.StructField("body", S.StringType()), S.StructField("only", S.BooleanType())])))
def _python(texts: pd.Series) -> pd.Series:
    """Top-level functions and classes of Python texts, decorators included; null for what does not parse."""

    def one(text: str | None) -> list | None:
        try:
            body = ast.parse(text or "").body
        except (SyntaxError, ValueError, RecursionError):
            return None
        rows = (text or "").split("\n")
        named = [n for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        return [{"name": n.name, "body": "\n".join(rows[min([n.lineno, *[d.lineno for d in n.decorator_list]]) - 1 : n.end_lineno]), "only": len(body) == 1} for n in named]

    return pd.Series([one(t) for t in texts], dtype=object)


def declarations(path: Column, text: Column, least: Column) -> Column:
    """Array of (title, body): a piece per top-level declaration; null if there is none.

    Python is parsed; in JavaScript, TypeScript and Go a declaration begins at the left margin and goes on over indented and
    blank lines and lines that begin with a closing bracket. Short pieces are left out unless the file has one only.
    """
    end = T.extension(path)
    by_margin = F.lit(None).cast("array<string>")
    for ends, words in ((T.SCRIPT_FILES, _SCRIPT), (["go"], _GO)):
        by_margin = F.when(end.isin(ends), F.regexp_extract_all(text, F.lit(f"(?md)^{words}[ \\t]+[A-Za-z_$][^\\n]*(?:\\n(?:[ \\t)}}\\]][^\\n]*|(?=\\n)))*+"), F.lit(0))).otherwise(by_margin)
    named = F.transform(by_margin, lambda b: F.struct(F.regexp_extract(b, f"\\A(?:{_GO}|{_SCRIPT})[ \\t]+([A-Za-z_$][A-Za-z0-9_$]*)", 1).alias("name"), b.alias("body"), (F.size(by_margin) == 1).alias("only")))
    found = F.when(end == "py", _python(F.when(end == "py", text))).otherwise(named)
    trimmed = F.transform(found, lambda d: F.struct(F.concat(path, F.lit(" › "), d["name"]).alias("title"), F.regexp_replace(d["body"], "\\A\\s+|\\s+\\z", "").alias("body"), d["only"].alias("only")))
    kept = F.transform(F.filter(trimmed, lambda d: d["only"] | (F.length(d["body"]) >= least)), lambda d: F.struct(d["title"].alias("title"), d["body"].alias("body")))
    return _let(kept, lambda k: F.when(F.size(k) > 0, k))


def chunk_settings(projects: DataFrame) -> DataFrame:
    """(project_id, strategy, max_chars, overlap, min_chars, prefix) of each project; what is absent or no use takes the defaults."""
    said = lambda field: F.get_json_object("chunk_cfg", f"$.{field}")
    number = lambda field, least, default: F.when(said(field).try_cast("int") >= least, said(field).try_cast("int")).otherwise(default)
    return projects.select(
        F.col("id").alias("project_id"),
        F.coalesce(said("strategy"), F.lit("auto")).alias("strategy"),
        number("max_chars", 1, MAX_CHARS).alias("max_chars"),
        number("overlap", 0, OVERLAP).alias("overlap"),
        number("min_chars", 0, MIN_CHARS).alias("min_chars"),
        F.coalesce(said("context_prefix").try_cast("boolean"), F.lit(True)).alias("prefix"),
    ).dropDuplicates(["project_id"])


def chunk_files(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, prefix: bool = True, declared: bool = True) -> DataFrame:
    """(id, ordinal, title, text, unit_type) of files (id, rel_path, content), by the strategy of the extension.

    Columns strategy, max_chars, overlap, min_chars and prefix set these per file; where they are absent or null the
    arguments hold. Source files give their declarations (unless declared is off) if they have any, other code line
    windows, markdown its sections, text windows of characters. Pieces under min_chars are dropped unless the file gave
    one only; ordinals count the pieces that are kept. Null contents and paths give no rows.
    """
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)).alias(name) if name in files.columns else F.lit(default).alias(name)
    kind = T.strategy(F.col("rel_path"), F.col("strategy") if "strategy" in files.columns else None).alias("strategy")
    sizes = [given("max_chars", max_chars), given("overlap", overlap), given("min_chars", min_chars), given("prefix", prefix)]
    ready = files.where("content is not null and rel_path is not null").select("id", "rel_path", F.replace("content", F.lit("\0"), F.lit("")).alias("content"), kind, *sizes)
    path, text, most, lap, least = (F.col(c) for c in ("rel_path", "content", "max_chars", "overlap", "min_chars"))
    step = F.greatest(F.lit(1), most - lap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - most) / step)).cast("int"))
    piece = lambda title: lambda b: F.struct(title.alias("title"), F.regexp_replace(b, "\\A\\s+|\\s+\\z", "").alias("body"))
    raw = (
        F.when(F.col("strategy") == "markdown", sections(text, most))
        .when(F.col("strategy") == "code", F.transform(line_windows(text, most, lap), piece(path)))
        .otherwise(F.transform(F.transform(starts, lambda i: F.substring(text, i * step + 1, most)), piece(path)))
    )
    own = declarations(path, text, least) if declared else F.lit(None).cast("array<struct<title:string,body:string>>")
    cut = ready.select("*", F.explode(F.array(F.struct(own.alias("own"), raw.alias("raw")))).alias("p"))
    kept = F.coalesce(F.col("p.own"), F.filter("p.raw", lambda x: (F.length(x["body"]) >= least) | (F.size("p.raw") == 1)))
    rows = cut.select("id", "rel_path", "prefix", F.posexplode(kept).alias("ordinal", "x"))
    title, body = F.col("x.title"), F.col("x.body")
    titled = F.when(F.col("prefix") & (F.coalesce(title, F.lit("")) != "") & ~body.startswith(title), F.concat(title, F.lit("\n\n"), body)).otherwise(body)
    return rows.select("id", "ordinal", title.alias("title"), titled.alias("text"), T.unit_type(titled, F.col("rel_path")).alias("unit_type"))
