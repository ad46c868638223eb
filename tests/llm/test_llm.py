"""Small fixtures for the training-data operators: brute force, round trips, and the defined results of odd inputs."""

import ast
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations, grammar, mixing, neighbours, packing, pairs, splitting, subjects, syntax


def test_split_covers_and_bounds(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word ", "x", "\n\n", ". ", "。", "\r\n", "𝄞", "é", "\t"]) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["y" * 200, "", None, "short"]
    df = spark.createDataFrame([(i, t, 40, 10, "keep") for i, t in enumerate(texts)], "id int, content string, max_chars int, overlap int, piece string")
    rows = splitting.split_oversized(df).orderBy("id", "piece_no").collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.id == i]
        if t is None or len(t) <= 40:
            assert not mine
            continue
        assert "".join(r.piece[r.overlap_chars :] for r in mine) == t and max(len(r.piece) for r in mine) <= 40
        assert all(t[r.start - r.overlap_chars :].startswith(r.piece) for r in mine)
        forced = any(r.boundary in ("forced", "stop") for r in mine)
        assert forced == bool(re.search(r"[^ \t\r\n]{41}", t))
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_chunk_config_defaults(spark):
    cfg = ['{"max_chars": "600", "overlap": 5}', '{"max_chars": 0}', "not json", None]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cfg)], "id string, chunk_cfg string")
    assert [tuple(r)[1:] for r in splitting.chunk_config(df).orderBy("project_id").collect()] == [(600, 5), (1500, 150), (1500, 150), (1500, 150)]


PAIRS = [
    ("how do I reset it?", None, "empty"), ("how do I reset it?", "​ ", "empty"), ("how do I reset it?", "N/A", "empty"), ("how do I reset it?", "```\n```", "empty"),
    ("how do I reset the old tray?", "> How do I reset the old tray", "copy"), ("please rename a-b to c everywhere", "Renamed a-b to c everywhere.", None),
    ("how do I reset the old tray?", "how do I reset the old tray?\nhow do I reset the old tray?", "copy"),
    ("how do I reset it?", "I’m sorry, but I can’t help with that. I hope you understand.", "refusal"), ("how do I reset it?", "Sorry for the delay. The reset is done and the page is back.", None),
    ("how do I reset it?", "Das ist nicht schwer, es geht mit der Taste und dem Schalter.", "other_language"), ("how do I reset it, auf Deutsch bitte", "Das ist nicht schwer, es geht mit der Taste.", None),
    ("how do I reset it?", "The page is open and the", "truncated"), ("how do I reset it?", "Use this:\n```\nreset --all", "truncated"), ("how do I reset it?", "```\nreset --all\n```", None), (None, "The page is back.", None),
]


def test_pair_defects(spark):
    filler = [(100 + i, "what is it?", f"The page is open and the page is back. It is all there, and the end of the page is near {i}.") for i in range(30)]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(PAIRS)] + filler, "resolution_id long, question string, answer string")
    said = [("en", "how do i reset it and the page is open, the page is back, it is all there"), ("DE", "das ist nicht schwer, es geht mit der Taste und dem Schalter auf Deutsch"), ("french", "c'est la page et le reste")]
    texts = spark.createDataFrame([(i, said[i % 3][1], said[i % 3][0]) for i in range(60)] + [(90, None, "en"), (91, "x", None)], "id long, text string, lang string")
    got = {r.resolution_id: r.defect for r in pairs.defects(df, texts).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(PAIRS) if d}
    assert pairs.defects(df.limit(0), texts).count() == 0
    unlabelled = {r.resolution_id: r.defect for r in pairs.defects(df, texts.limit(0)).collect()}
    assert unlabelled == {i: d for i, d in got.items() if d != "other_language"}


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert pairs._common(a, b) == slow(a, b)


def test_conversations(spark, tmp_path):
    sessions = {
        "ok": [("user", "hi"), ("Bot ", "yes")], "noreply": [("user", "hi"), ("user", "again")], "blank": [("user", "hi"), ("bot", "​")], "tools": [("tool", "x")],
        "role": [("user", "hi"), ("alien", "x")], "machine": [("user", "<system-reminder> x"), ("bot", "y")], "split": [("user", "a"), ("bot", " "), ("user", "b"), ("bot", "c")],
    }
    rows = [(f"{s}{i}", s.upper() if i else s, "p", r, i, t) for s, ts in sessions.items() for i, (r, t) in enumerate(ts)]
    rows += [("d1", "ok", "p", "user", 0, " hi "), ("g0", "gap", "p", "user", 0, "a"), ("g2", "gap", "p", "bot", 2, "b"), ("c0", "clash", "p", "user", 0, "a"), ("c1", "clash", "p", "user", 0, "b"), ("n0", "null", "p", "user", None, "a"), ("x", None, "p", "user", 0, "a")]
    df = spark.createDataFrame(rows, "id string, session_id string, project_id string, role string, seq int, text string")
    at = F.when(F.col("id") == "ok1", F.lit("2026-06-01")).otherwise("2025-01-01").cast("timestamp")
    df.withColumn("created_at", at).write.parquet(f"{tmp_path}/message.parquet")
    spark.createDataFrame([("user", "user"), ("bot", "assistant"), ("tool", "tool")], "alias string, role string").write.parquet(f"{tmp_path}/role_alias.parquet")
    spark.createDataFrame([("OK",), ("lonely",), (None,)], "id string").write.parquet(f"{tmp_path}/chat_session.parquet")
    dropped = {r[0] for r in conversations.found(spark, str(tmp_path)).collect()}
    assert dropped == {"noreply", "blank", "tools", "role", "split", "gap", "clash", "null", "lonely"}
    kept = conversations.conversations(spark, str(tmp_path)).where("session_id = 'ok'").orderBy("turn").collect()
    assert [(r.role, r.text) for r in kept] == [("user", "hi"), ("assistant", "yes")]


def test_reduced_shapes_join_like_the_whole(spark):
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("UAa", repeat=n)]
    df = spark.createDataFrame([(w, w[:k], w[k:]) for w in words for k in range(len(w) + 1)], "w string, a string, b string")
    r = conversations._reduced
    parts = r(F.concat(r(F.col("a")), r(F.col("b"))))
    bad = lambda c: c.rlike("V|Ua*$")
    plain = F.col("w").rlike("Ua+U|Ua*$")
    assert df.where((bad(parts) != plain) | (bad(r(F.col("w"))) != plain)).count() == 0


SOURCES = {
    "py": ["x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return [i for i in a if i not in b]\n", "if x:\n  pass\nelse:\n  y = {1: 2, **z}\n", "try:\n    f()\nexcept (A, B) as e:\n    raise C from e\n", "@d\nclass A(B): x: int = 1\n", "", "# only\n", "s = '''a\n<<<<<<< b'''\n", "lambda x, y=1: x if y else z\n", "async def g():\n    async with a as b, c:\n        yield\n", "print(f'{x}', end='')\nx[1:2, ::3] += -y ** 2\n", "for a, b in c:\n    break\nelse:\n    pass\n", "import a.b as c\nfrom . import (d, e as f)\n", "[row_0]\nname = 1\n", "match x:\n    case [1, _]:\n        pass\n"],
    "json": ['{"a": [1, -2.5e3, null, true, {"b": []}]}', "[]", '"x"', "1"],
    "toml": ["a = 1\n[b]\nc.d = [1, [2],\n 3,\n]\n[[e]]\nf = {g = 1, h = 'x'}\n", "", "# c\n", "d = 2024-01-01\ns = \"\"\"a\nb\"\"\"\n"],
    "js": ["const a = { b: [1, 2], c () { return /[({]+/g }, ...d }\nexport default function (x, y = 1) { for (const z of x) { if (z) break\n else continue } }\n", "x = a ? b : c\nawait y\n", "class A extends B { #p = 1; static q () {} get r () { return `${1}` } }\nimport a, { b as c } from 'd'\n", ""],
    "ts": ["export interface A<T> { a?: Array<{ n: number }>; b: string | null }\nconst f = async (x: Map<string, T[]>): Promise<void> => { return }\ntype B = 'a' | 'b'\n", "function g<T extends { n: number }> (a: T[], b: number = 1): T[] { return a as T[] }\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\tA string `j:\"a\"`\n\tB map[string][]int\n}\n\nfunc (t *T) F(x []string, n int) ([]string, error) {\n\tif err := g(); err != nil {\n\t\treturn nil, err\n\t} else {\n\t\tgo h()\n\t}\n\tfor i, v := range x {\n\t\ty[i] = v + \"z\"\n\t}\n\treturn x, nil\n}\n"],
    "sql": ["CREATE TABLE t (id integer NOT NULL, a varchar(10) DEFAULT 'x', b numeric(10, 2), PRIMARY KEY (id));\nINSERT INTO t (id, a) VALUES (1, 'it''s'), (2, NULL);\nSELECT a.id, count(*) AS n FROM t a JOIN (SELECT id, max(b) AS m FROM t GROUP BY id) c ON (a.id = c.id) WHERE (a.a IN ('x', 'y') AND c.m > 1) GROUP BY a.id;\n", "BEGIN;\nCOMMIT;\n", ""],
}
BROKEN = {
    "py": ["def f(:\n  pass\n", "x = (1\n", "if x:\npass\n", "try:\n    f()\n", "x = 1\n  y = 2\n", "<<<<<<< a\nx = 1\n", "s = 'a\n", "a b\n", "@d\n", "x = 2c4\n", "else:\n    pass\n", "f()]\n", "x = 1 …\n", "def f():\n"],
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", '{"a": 1}}', "<<<<<<< x", '["a\nb"]', "01"],
    "toml": ["a =\n", "a = b\n", "[a\n", "a = 1 b = 2\n", "import x\n", 'a = "x\n', "{\n}"],
    "js": ["const a = {\n", "import json\n", "const x: number = 1\n", "{\n  \"name\": 1,\n  \"b\": 2\n}\n", "f(\n", "<<<<<<< a\n", "package b\n", "x = 'a\n"],
    "ts": ["export interface A {\n  a: string\n", "def f(x):\n    return x\n", "=======\n"],
    "go": ["x := 1\n", "package a\nfunc f() {\n", "package a\nconst x = {\n", "def f():\n  pass\n"],
    "sql": ["Who owns this page now?\n", "SELECT (a FROM t;\n", "CREATE TABLE (\n", "<<<<<<< HEAD\nSELECT 1;\n", "const a = {}\n"],
}


def test_syntax(spark):
    rows = [(f"{k}-{lang}-{i}", lang, t) for k, src in (("good", SOURCES), ("bad", BROKEN)) for lang, ts in src.items() for i, t in enumerate(ts)]
    rows += [("null", "py", None), ("other", "md", "(")]
    bad = {r.id for r in syntax.unparsable(spark.createDataFrame(rows, "id string, lang string, content string")).collect()}
    assert bad == {r[0] for r in rows if r[0].startswith("bad")}
    for i, t in enumerate(SOURCES["py"]):
        ast.parse(t)
    for t in BROKEN["py"]:
        with pytest.raises(SyntaxError):
            ast.parse(t)


def test_pairs_from_productions():
    assert grammar.pairs(r"a(?:b|c)*d?") == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("b", "d"), ("c", "d")}
    assert grammar.pairs(r"a(?=[bc])(?:b|c|d)") == {("a", "b"), ("a", "c")}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) + 3 * rng.normal(size=(6, 8))[rng.integers(0, 6, 300)]
    rows = [(f"v{i:03d}", [float(f) for f in v]) for i, v in enumerate(x.astype(np.float32))]
    rows += [("copy%02d" % i, rows[0][1]) for i in range(15)] + [rows[1], ("zero", [0.0] * 8), ("short", [1.0]), ("nan", [float("nan")] * 8), ("null", None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "embedding_id string, embedding array<float>")
    got = neighbours.nearest(df, k=5, dim=8, centroids=4).collect()
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:-5] if i}
    assert {r.id for r in got} == set(usable)
    ids = sorted(usable)
    m = np.array([usable[i] for i in ids])
    hit = total = 0
    for a, i in enumerate(ids):
        s = np.round(m @ m[a], 5)
        want = [ids[b] for b in np.lexsort((ids, -s)) if b != a][:5]
        mine = {r.neighbour for r in got if r.id == i}
        assert len(mine) == 5 and i not in mine
        hit, total = hit + len(mine & set(want)), total + 5
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), dim=8).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice([20, 64, 256])
    counts = {s: rng.randint(0, 30) for s in range(1, cap + 1) if rng.random() < 0.4}
    rows = packing.plan_containers(counts, cap)
    load, placed = {}, dict.fromkeys(counts, 0)
    for s, first, end, each, base in rows:
        assert first == placed[s]
        placed[s] = end
        for k in range(first, end):
            c = base + (k - first) // each
            load[c] = load.get(c, 0) + s
    assert placed == counts and max(load.values(), default=0) <= cap
    least = max(-(-sum(s * n for s, n in counts.items()) // cap), sum(n for s, n in counts.items() if 2 * s > cap))
    assert len(load) <= least * 1.2 + 2  # few small items are left for the late, large ones here


def test_pack_rows(spark):
    sizes = [(1, 700), (2, 256), (3, 0), (4, None), (5, 100), (5, 100), (6, 56)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, size long"), spark.createDataFrame([("s", 256), ("bad", 0), ("n", None)], "container_id string, capacity long")).collect()
    assert {r.doc_id for r in got if r.pieces > 1} == {1} and sum(r.tokens for r in got) == 1212 and len(got) == 9
    load = {}
    for r in got:
        load[r.container_no] = load.get(r.container_no, 0) + r.tokens
    assert max(load.values()) == 256 and len(load) == 5


def test_sainte_lague_equals_seat_by_seat():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.random() for _ in range(rng.randint(1, 6))]
        seats, caps = rng.randint(0, 50), [rng.randint(0, 20) for _ in w] if rng.random() < 0.5 else None
        want = [0] * len(w)
        for _ in range(seats):
            q, i = max((x / (2 * k + 1) if caps is None or k < caps[j] else -1, -j) for j, (x, k) in enumerate(zip(w, want)))
            if q > 0:
                want[-i] += 1
        assert mixing.sainte_lague(np.array(w), seats, None if caps is None else np.array(caps)).tolist() == want


def test_mix(spark):
    items = [(i, " A " if i % 2 else "b", 50) for i in range(400)] + [(1000, None, 5000), (1001, "b", None)]
    targets = [("m", "a", 0.5, 2, 0.4), ("m", "B", 0.5, 1, 0.4), ("z", "a", 1.0, 1, 1.0), ("z", "none", 0.1, 3, 1.0)]
    df = spark.createDataFrame(items, "doc_id long, source string, tokens long")
    chosen, report = mixing.mix(df, spark.createDataFrame(targets, "mix_id string, source string, weight double, max_repeat int, total_share double"))
    short = {(r.mix_id, r.source) for r in report.where("short").collect()}
    assert short == {("z", "a"), ("z", "none")}
    got = {(r.mix_id, r.source): (r.n, r.most) for r in chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"), F.max("repeats").alias("most")).collect()}
    assert got[("m", "a")][0] == pytest.approx(5000, rel=0.05) and got[("m", "B")][0] == pytest.approx(5000, rel=0.05) and got[("z", "a")] == (10000, 1)


def test_subjects(spark):
    rng = random.Random(5)
    nouns = {"law": ["court", "clause", "statute", "appeal"], "food": ["broth", "yeast", "oven", "dough"], "sport": ["coach", "relay", "match", "stadium"]}
    say = lambda s: f"The {rng.choice(nouns[s])} was kept beside the {rng.choice(nouns[s])} all day."
    docs, truth = [], {}
    for i in range(240):
        s = rng.sample(sorted(nouns), rng.choice([0, 1, 1, 2]))
        lines = [say(x) for x in s for _ in range(4)] + ["To be continued.", "Nothing to add today."]
        docs.append((i, "# The court\n\n" + "\n".join(lines) + "\n```\ncourt broth coach\n```"))
        truth[i] = set(s)
    docs += [(900, None), (901, "")]
    labels = [(i, s, "a") for i in range(0, 240, 2) for s in (truth[i] or {None})]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = spark.createDataFrame([(s, s) for s in nouns], "subject string, description string")
    got: dict = {}
    for r in subjects.found(d, a, spark.createDataFrame(labels, "doc_id long, subject string, annotator string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == s for i, s in truth.items())
    assert right >= 225 and not {900, 901} & set(got)
