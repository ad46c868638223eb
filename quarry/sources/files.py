"""Files of a folder tree: selection by globs and ignore rules, decoding."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = re.compile(r"\*\*/|\*\*|\*|\?|\{[^{}]*\}|.", re.S)
_WILD = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def _body(glob: str) -> str:
    def part(m: re.Match) -> str:
        t = m.group()
        if t in _WILD:
            return _WILD[t]
        return "(?:" + "|".join(map(_body, t[1:-1].split(","))) + ")" if len(t) > 1 else re.escape(t)

    return _PARTS.sub(part, glob)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** crosses folders, * and ? do not, {a,b} is either."""
    return f"^{_body(glob)}$"


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether ignore rules leave the path out: the last rule that matches decides, ! takes back, a / inside or in front
    ties a rule to the root, one at the end means folders. Blank rules and comments say nothing; a null path is not ignored."""
    said = []
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        folder, bare = rule.endswith("/"), rule.rstrip("/")
        front = "" if "/" in bare else "(?:.*/)?"
        pattern = f"^{front}{_body(bare.lstrip('/'))}" + ("/.*$" if folder else "(?:/.*)?$")
        said.append(F.when(path.rlike(pattern), not keep))
    return F.coalesce(*reversed(said), F.lit(False)) if said else F.lit(False)


def selected(path: Column, globs: Sequence[str] = ("**/*",), rules: Sequence[str] = ()) -> Column:
    """Whether a relative path is to be read: some glob has it, no part of it is .git, and the ignore rules do not have it."""
    some = F.lit(False)
    for g in globs:
        some = some | path.rlike(glob_regex(g))
    return F.coalesce(some & ~F.array_contains(F.split(path, "/"), ".git") & ~ignored(path, rules), F.lit(False))


def scan_files(spark: SparkSession, root: str, globs: Sequence[str] = ("**/*",), rules: Sequence[str] = ()) -> DataFrame:
    """(rel_path, content, content_hash, mtime, size) of the files below root.

    Paths are chosen before contents are read. Contents are UTF-8 without NUL, wrong bytes as U+FFFD; the hash is of the
    text after that. A file that several globs have comes once.
    """
    base = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z0-9]+:/+', '/'), {len(base) + 2})")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\0"), F.lit(""))
    chosen = files.withColumn("rel_path", rel).where(selected(F.col("rel_path"), globs, rules))
    return chosen.select("rel_path", text.alias("content"), F.sha2(text, 256).alias("content_hash"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
