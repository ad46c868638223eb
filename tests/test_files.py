"""Files, ignore rules, imports, labels, transcripts' lines and graphs of groups on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, graph
from quarry.sources import files, transcripts


def chosen(spark, paths, globs=("**/*",), rules=()):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return sorted(r.p for r in df.where(files.selected(F.col("p"), globs, rules)).collect())


def test_globs_and_git_folder(spark):
    paths = ["a.py", "src/b.py", "src/deep/c.ts", ".git/config", "x/.git/y.py", "src/.github/z.py", None]
    assert chosen(spark, paths) == ["a.py", "src/.github/z.py", "src/b.py", "src/deep/c.ts"]
    assert chosen(spark, paths, ["*.py"]) == ["a.py"]
    assert chosen(spark, paths, ["src/*.{py,ts}", "src/**"]) == ["src/.github/z.py", "src/b.py", "src/deep/c.ts"]
    assert chosen(spark, paths, []) == []


@pytest.mark.parametrize(
    ("rules", "left"),
    [
        ([], ["build/a.o", "docs/a.txt", "docs/x/b.txt", "src/build/c.o"]),
        (["build/"], ["docs/a.txt", "docs/x/b.txt"]),
        (["/build"], ["docs/a.txt", "docs/x/b.txt", "src/build/c.o"]),
        (["*.txt", "!docs/*.txt", "", "# c"], ["build/a.o", "docs/a.txt", "src/build/c.o"]),
        (["!docs/*.txt", "*.txt"], ["build/a.o", "src/build/c.o"]),
    ],
)
def test_ignore_rules(spark, rules, left):
    assert chosen(spark, ["build/a.o", "src/build/c.o", "docs/a.txt", "docs/x/b.txt"], rules=rules) == left


def test_scan_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.md").write_bytes(b"x\0y")
    (tmp_path / "d" / "b.md").write_bytes(b"\xff!")
    (tmp_path / "d" / "c.bin").write_bytes(b"1")
    rows = files.scan_files(spark, str(tmp_path), ["**/*.md", "a.*"]).orderBy("rel_path").collect()
    assert [(r.rel_path, r.content, r.size) for r in rows] == [("a.md", "xy", 3), ("d/b.md", "�!", 2)]
    import hashlib

    assert rows[0].content_hash == hashlib.sha256(b"xy").hexdigest()


def test_imports(spark):
    rows = [
        ("import a from 'm/a'\nimport {\n  b,\n} from \"m/b\"\nimport './side.css'\nexport * from 'm/a'\nconst s = 'no from \"x\"'", "x.TS", ["./side.css", "m/a", "m/b"]),
        ('package p\nimport (\n\t"fmt"\n\tq "net/url"\n)\nimport "os"\n', "x.go", ["fmt", "net/url", "os"]),
        ("import os", "x.py", []),
        (None, "x.ts", []),
        ("import 'a'", None, []),
        ("", "x.go", []),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, p string")
    got = df.orderBy("i").select(T.imports(F.col("t"), F.col("p"))).collect()
    assert [(r[0] or []) for r in got] == [r[2] for r in rows]


def test_urls_labels_hues_and_ages(spark):
    df = spark.createDataFrame(
        [(0, "https://h/{path}?r={path}", "a/b"), (1, "https://h/", "a"), (2, None, "a"), (3, "", "a")], "i int, t string, p string"
    ).orderBy("i")
    assert [r[0] for r in df.select(T.build_url(F.col("t"), F.col("p"))).collect()] == ["https://h/a/b?r={path}", "https://h/a", None, None]
    df = spark.createDataFrame([(0, " x/y ", None), (1, None, "one two  three four five"), (2, "", None), (3, "z" * 40, None), (4, "a/", None)], "i int, t string, s string")
    assert [r[0] for r in df.orderBy("i").select(T.descriptor(F.col("t"), F.col("s"))).collect()] == ["y", "one two three four", "·", "z" * 33 + "…", "a/"]
    h = 0
    for c in "project-1":
        h = (h * 31 + ord(c)) % 2**32
    df = spark.createDataFrame([(0, "project-1"), (1, ""), (2, None)], "i int, n string").orderBy("i")
    assert [r[0] for r in df.select(T.hue(F.col("n"))).collect()] == [h % 360, 0, 0]
    at = lambda s: F.timestamp_seconds(F.lit(1_000_000 - s))
    ages = [T.relative_age(at(s), at(0)).alias(f"a{i}") for i, s in enumerate([0, 89, 90, 5399, 5400, 129600, -1])]
    assert list(spark.range(1).select(*ages, T.relative_age(F.lit(None).cast("timestamp"), at(0)).alias("z")).first()) == ["0s", "89s", "2m", "90m", "2h", "2d", "", ""]


def test_annotate(spark):
    df = spark.createDataFrame([(0, "see § 1 and § 1", ["§ 1"]), (1, "x", None), (2, None, ["x"])], "i int, t string, u array<string>").orderBy("i")
    assert [r[0] for r in df.select(T.annotate(F.col("t"), F.col("u"), "?")).collect()] == ["see § 1? and § 1?", "x", None]


def test_transcript_lines(spark):
    lines = [
        json.dumps({"type": "user", "content": "plain"}),
        json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"content": ["b", {"text": "c"}]}]}}),
        json.dumps({"payload": {"type": "message", "role": "tool", "content": "dropped"}}),
        json.dumps({"type": "user", "content": " "}),
        json.dumps({"type": "user", "content": "12"}),
        "{broken", "", "3",
    ]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("f", 99, None)], "path string, at int, line string")
    got = [(r["at"], r["role"], r["text"]) for r in transcripts.parse_lines(df).orderBy("at").collect()]
    assert got == [(0, "user", "plain"), (1, "assistant", "a\nb\nc"), (4, "user", "12")]
    assert transcripts.parse_lines(df.limit(0)).count() == 0


def test_chunk_settings_per_project(spark):
    cfg = [("a", '{"max_chars": "300", "min_chars": 0, "overlap": 0, "context_prefix": false}'), ("b", None), ("c", '{"max_chars": -1, "overlap": "x", "strategy": "text"}'), ("d", "no json")]
    s = {r.project_id: r for r in chunking.chunk_settings(spark.createDataFrame(cfg, "id string, chunk_cfg string")).collect()}
    assert (s["a"].max_chars, s["a"].min_chars, s["a"].overlap, s["a"].prefix) == (300, 0, 0, False)
    for p in "bcd":
        assert (s[p].max_chars, s[p].min_chars, s[p].overlap, s[p].prefix) == (1500, 200, 150, True)
    assert s["c"].strategy == "text"
    rows = spark.createDataFrame([("1", "a.txt", "x" * 700, 300, 0, 0, False), ("2", "a.txt", "x" * 700, None, None, None, None)], "id string, rel_path string, content string, max_chars int, overlap int, min_chars int, prefix boolean")
    got = [(r.id, r.ordinal, len(r.text)) for r in chunking.chunk_files(rows).orderBy("id", "ordinal").collect()]
    assert got == [("1", 0, 300), ("1", 1, 300), ("1", 2, 100), ("2", 0, 700 + len("a.txt\n\n"))]


def test_group_graphs(spark):
    rows = [(i, "g" if i % 3 else "h", [float(i % 7), float(i % 5), float(i % 3), 1.0]) for i in range(90)] + [(200, "tiny", [1.0, 0.0, 0.0, 0.0]), (201, None, None), (202, None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, group string, vec array<double>")
    a = {r.id: r for r in graph.group_graphs(df, n=30, least=24).collect()}
    assert len([r for r in a.values() if r.group == "g"]) == 24 and len([r for r in a.values() if r.group == "h"]) == 24
    assert {r.group for r in a.values()} == {"g", "h", "tiny", ""} and a[200].links == []
    vec = {r[0]: r[2] for r in rows}
    for r in a.values():
        if r.group == "g":
            dots = sorted((sum(x * y for x, y in zip(vec[r.id], vec[o])) for o in a if a[o].group == "g" and o != r.id), reverse=True)
            assert [x.weight for x in r.links] == pytest.approx(dots[:3])
    assert {r.id: r for r in graph.group_graphs(df.orderBy(F.desc("id")), n=30, least=24).collect()} == a
    assert graph.group_graphs(df.limit(0)).count() == 0
