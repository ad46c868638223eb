"""Small fixtures for the core: golden values, nulls, ties, repeated rows, empty tables, clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators import chunking, graph, memory, retrieval, skew, snapshot
from quarry.sources import transcripts


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()[0]


def test_intent_key_and_terms(spark):
    assert one(spark, "Hey, can you reset the dev database please", T.intent_terms) == ["reset", "dev", "database"]
    assert one(spark, "reset dev database", T.intent_key) == "if6c5b7d4a55fa2d5f65737b8f3e373"
    assert one(spark, None, T.intent_terms) == []
    assert one(spark, "run `x y` ```\ncode\n``` now", T.intent_terms) == ["run"]


@pytest.mark.parametrize(("text", "tokens"), [("", 1), (None, 1), ("ab", 1), ("0123456789", 3)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, text, T.token_estimate) == tokens


def test_references_in_order(spark):
    got = [(r.kind, r.uri) for r in one(spark, "See https://a.example/x). RFC 7231, 228/1929 and § 36, RFC 7231", T.references)]
    assert got == [("url", "https://a.example/x"), ("citation", "228/1929"), ("citation", "RFC 7231"), ("citation", "§ 36")]
    assert one(spark, None, T.references) == []


@pytest.mark.parametrize(
    ("text", "kind"), [("what do we do about retries", "scoped"), ("what does the standard say", "shared"), ("our standard", "balanced"), ("", "balanced"), (None, "balanced")]
)
def test_query_intent(spark, text, kind):
    assert one(spark, text, T.query_intent) == kind


def test_unit_types_and_strategy(spark):
    rows = [("# H\nx", "a.rst", "section", "text"), ("class A {}", "a.ts", "symbol", "code"), ("interface A {}", "a.ts", "definition", "code"), ("x = 1", "a.py", "code", "code"), (None, "a.md", "text", "markdown"), ("x", "noext", "text", "text")]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, p string")
    got = df.select(T.unit_type(F.col("t"), F.col("p")), T.strategy(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_half_up_and_cosine(spark):
    r = spark.range(1).select(T.half_up(F.lit(-0.5), 0), V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert r[0] == 0 and abs(r[1] - 0.5**0.5) < 1e-12 and r[2] is None


def test_latest_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, "y", 0), ("a", 2, "z", 0), (None, None, "n", 0)], "k string, at int, v string, __rank2 int")
    got = {r.k: r.v for r in snapshot.latest(df, ["k"], "at", ["v"]).collect()}
    assert got == {"a": "z", None: "n"}
    assert snapshot.latest(df.limit(0), ["k"], "at").count() == 0


def test_upsert_and_append(spark):
    a = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 9), ("d", 4)], "k string, v int")
    assert sorted(r.v for r in snapshot.upsert(a, b, ["k"]).collect()) == [1, 3, 4, 9]
    assert sorted(r.v for r in snapshot.append_absent(a, b, ["k"]).collect()) == [1, 2, 3, 4]


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 999)], "k string, i int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("k0", 3), ("zz", 4)], "k string, j int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, skew.skew_join(left, right, "k", how, rows=20).collect()), key=str) == want


@pytest.mark.parametrize(("n", "starts"), [(0, [0]), (1500, [0]), (1501, [0, 1350]), (2850, [0, 1350]), (2851, [0, 1350, 2700])])
def test_char_windows(spark, n, starts):
    df = spark.createDataFrame([(1, "é" * n), (2, None)], "k int, t string")
    got = chunking.char_windows(df, "k", "t").orderBy("ordinal").collect()
    assert [r.start for r in got] == starts and sum(len(r.text) for r in got) == n + 150 * (len(starts) - 1)


def test_chunk_files(spark):
    rows = [("m", "a.md", "intro " * 60 + "\n# One\n" + "body " * 60), ("p", "a.py", "def f():\n    return 1\n\nclass C:\n    x = 1\n"), ("c", "a.go", "\n".join(f"line {i}" * 10 for i in range(60))), ("b", "b.py", "def ("), ("n", "x.txt", None)]
    got = chunking.chunk_files(spark.createDataFrame(rows, "id string, rel_path string, content string"), min_chars=10).orderBy("id", "ordinal").collect()
    per = {k: [r for r in got if r.id == k] for k in "mpcbn"}
    assert [r.title for r in per["m"]] == [None, "One"] and per["m"][1].unit_type == "section"
    assert [r.title for r in per["p"]] == ["a.py › f", "a.py › C"] and per["p"][0].unit_type == "symbol"
    assert len(per["c"]) > 1 and not per["n"] and len(per["b"]) == 1


def test_retrieval_fusion_and_tiers(spark):
    corpus = spark.createDataFrame([(1, "p", "red fox"), (2, "p", "red red dog"), (3, "q", None), (4, "q", "")], "doc_id long, project string, text string")
    queries = spark.createDataFrame([("a", "red fox"), ("b", "absent"), ("c", None)], "query_id string, text string")
    got = retrieval.search(corpus, queries).where("query_id = 'a'").orderBy("rank").collect()
    assert got[0].doc_id == 1 and got[0].rrf == pytest.approx(2 / 61) and got[0].tier == "high"
    assert retrieval.search(corpus.limit(0), queries).count() == 0


def test_blocks_find_exact_neighbours(spark):
    rows = [(i, [float((i * 7) % 11) - 5, float((i * 3) % 5) - 2.5, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g int")
    got = retrieval.nearest_in_blocks(df, df, 3, "g", rows_per_block=7, queries_per_block=4).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for i, v, g in rows:
        want = sorted(((-round(cos(v, w), 6), j) for j, w, h in rows if h == g and j != i))[:3]
        assert [(r.id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [j for _, j in want]


def test_recall_loses_no_similar_intent(spark):
    texts = ["reset dev database", "reset dev server", "reset the dev database", "list open issues", "list closed issues", "", None, "deploy build server tonight"]
    df = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "id string, text string")
    got = {(r.query_id, r.id) for r in memory.recall(df, df, topk=9).collect()}
    sets = {f"i{i}": {w for w in (t or "").split() if w not in T.FILLER} for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.45}
    assert got == want


@pytest.mark.parametrize(
    ("nxt", "outcome", "score"),
    [("thanks, works", "resolved", 0.9), ("reset dev database again", "unresolved", 0.075), ("reset dev server", "partial", 0.5), ("no", "unresolved", 0.3), ("list open issues", "resolved", 0.7)],
)
def test_grades(spark, nxt, outcome, score):
    df = spark.createDataFrame([("1", "s", "user", 0, "reset dev database"), ("2", "s", "USER ", 3, nxt)], "id string, session_id string, role string, seq int, text string").withColumn("created_at", F.current_timestamp())
    r = memory.graded_turns(df).first()
    assert (r.outcome, r.score) == (outcome, pytest.approx(score))


def test_retention_keeps_newest(spark):
    df = spark.createDataFrame([(i, "x", 20.0 - i, "t") for i in range(14)] + [(0, "x", 20.0, "t")], "id long, intent_id string, score double, response_excerpt string").withColumn("ts", F.current_timestamp())
    got = sorted(r.id for r in memory.retained(df).collect())
    assert got == [*range(12), 13]


def test_graph_links_and_spiral(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.25)], "query_id long, id long, cosine double")
    edges = graph.links(near)
    assert edges.count() == 2 and {r.node: r.degree for r in graph.degrees(edges).collect()} == {1: 2, 2: 1, 3: 1}
    assert [tuple(r) for r in graph.spiral(spark.createDataFrame([(5,)], "g int"), "g").collect()] == [(5, 0.0, 0.0, 0.0)]
    two = graph.spiral(spark.createDataFrame([(1,), (2,)], "g int"), "g").orderBy("g").collect()
    assert [abs(r.y) for r in two] == [pytest.approx(3.85), pytest.approx(3.85)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"messages": [{"type": "user", "content": "hi"}, {"type": "gemini", "content": [{"text": "yo"}]}, {"type": "info", "content": "x"}]}, indent=1))
    plain = [{"message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"content": [{"text": "b"}]}]}}, {"type": "summary"}, {"message": {"role": "tool", "content": " "}}]
    (tmp_path / "plain.json").write_text("\n".join([*map(json.dumps, plain), "{broken", ""]))
    wrapped = [{"payload": {"type": "message", "role": "assistant", "content": [{"type": "t", "text": "w"}]}}, {"payload": {"type": "message", "role": "developer", "content": "d"}}]
    (tmp_path / "wrapped.json").write_text("\n".join(map(json.dumps, wrapped)))
    got = {(r.path.rsplit("/", 1)[1], r.seq, r.role, r.text) for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {("doc.json", 0, "user", "hi"), ("doc.json", 1, "assistant", "yo"), ("plain.json", 0, "user", "a\nb"), ("wrapped.json", 0, "assistant", "w")}


def test_history(spark, tmp_path):
    lines = [{"display": " fix it ", "timestamp": 1000, "project": "/p"}, {"display": "/clear"}, {"display": "<system-reminder> x"}, {"display": ""}, {"display": "next"}]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, lines)))
    got = [(r.text, r.project) for r in transcripts.read_history(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [("fix it", "/p"), ("next", None)]


def test_rest_works_without_the_llm_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    code = "import sys; sys.modules['quarry.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('p1_')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    users = [p for p in (root / "quarry").rglob("*.py") if "llm" not in p.parts and "quarry.llm" in p.read_text()]
    assert users == []
