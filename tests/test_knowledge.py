"""Small fixtures for ingest, grounding, search, memory merges and graphs: brute force and the defined results of odd inputs."""

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators import chunking, citations, graph, ingest, memory, retrieval, skew
from quarry.session import small
from quarry.sources.transcripts import history_messages
from quarry.streaming import tail

FILES = "id string, project_id string, source_id string, rel_path string, title string, url string, content string, mtime timestamp, created_at timestamp, state string"


def _files(spark, rows):
    at = F.to_timestamp(F.col("c"))
    df = spark.createDataFrame([(i, "p", s, path, None, None, text, at) for i, s, path, text, at in rows], "id string, project_id string, source_id string, rel_path string, title string, url string, content string, c string")
    return df.select("id", "project_id", "source_id", "rel_path", "title", "url", "content", at.alias("mtime"), at.alias("created_at"), F.lit("mine").alias("state"))


def test_ingest_merges_what_changed(spark):
    doc = "# one\n\nsee https://a.example/x and 12/345.\n\n# two\n\nplain words here"
    chunker = lambda f: chunking.chunk_files(f, min_chars=0, declared=False)
    first = _files(spark, [("a", "s", "a.md", doc, "2025-01-01"), ("b", "s", "b.ts", "import x from 'lib'\nconst a = 1\n", "2025-01-01"), ("n", None, "n.txt", None, "2025-01-01"), ("e", "s", "e.txt", "", "2025-01-01")])
    store, stats = ingest.ingest(ingest.empty_store(first), first, V.hash_embed, chunker)
    assert stats.first().asDict() == {"files": 4, "changed": 4, "chunks": 4, "embedded": 4}
    assert {(r.kind, r.uri) for r in store.references.collect()} == {("url", "https://a.example/x"), ("citation", "12/345"), ("module", "lib")}
    # b comes again under another id, unchanged; a loses a section; n gets a text; c is new and repeats a text
    second = _files(spark, [("b2", "s", "b.ts", "import x from 'lib'\nconst a = 1\n", "2025-02-01"), ("a2", "s", "a.md", "# two\n\nplain words here", "2025-02-01"), ("n2", None, "n.txt", "text", "2025-02-01"), ("c", "s", "c.md", "# two\n\nplain words here", "2025-02-01"), ("c", "s", "c.md", "older", "2025-01-15")])
    store, stats = ingest.ingest(store, second, V.hash_embed, chunker)
    assert stats.first().asDict() == {"files": 4, "changed": 3, "chunks": 3, "embedded": 1}
    docs = {r.id: r for r in store.documents.collect()}
    assert set(docs) == {"a", "b", "n", "e", "c"} and str(docs["a"].created_at)[:10] == "2025-01-01" and str(docs["a"].updated_at)[:10] == "2025-02-01"
    chunks = store.chunks.collect()
    assert sorted((r.document_id, r.ordinal) for r in chunks) == [("a", 0), ("b", 0), ("c", 0), ("e", 0), ("n", 0)]
    assert {r.relation for r in store.links.collect()} == {"imports"} and store.references.count() == 3
    assert store.vectors.count() == len({r.content_hash for r in chunks if r.text.strip()}) + 1  # vectors of texts that are gone stay
    assert {r.chunks for r in ingest.fingerprints(store.chunks).collect()} == {1}
    empty, stats = ingest.ingest(ingest.empty_store(first), first.limit(0), V.hash_embed, chunker)
    assert empty.documents.count() == 0 and stats.first().asDict() == {"files": 0, "changed": 0, "chunks": 0, "embedded": 0}


def test_vectors_stay_and_take_counts(spark):
    cells = "space_id string, content_hash string, token_count int, embedding array<double>"
    stored = spark.createDataFrame([("s", "h", 1, [1.0]), ("t", "h", 2, [2.0])], cells)
    new = spark.createDataFrame([("s", "h", 9, [5.0]), ("s", "h", 8, [6.0]), ("s", "k", None, [7.0])], cells)
    assert sorted(tuple(r) for r in ingest.merge_vectors(stored, new).select("space_id", "content_hash", F.coalesce("token_count", F.lit(-1)), F.col("embedding")[0]).collect()) == [("s", "h", 9, 1.0), ("s", "k", -1, 7.0), ("t", "h", 2, 2.0)]


def test_containment_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    pool = ["iso", "9001", "§", "5", "12/34", "a-b", "é", "straße", "x1y2", "https://h.example/p", "(z)"]
    texts = [(i, rng.choice(["", " "]).join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(500, None), (501, "")]
    uris = ["".join(rng.choice(["", " "]) + rng.choice(pool) for _ in range(rng.randint(1, 3))).strip() for _ in range(120)] + ["so", "1", "x1", "TRASS", "o9", None, "", "ISO 9001", "aa", "example", "ttps", "h.ex", "5"]
    got = {r.uri: r.text_id for r in citations.contained(spark.createDataFrame([(u, "clash") for u in uris], "uri string, text string"), spark.createDataFrame(texts, "id int, text string")).collect()}
    want = {u: min(i for i, t in texts if t and u.lower() in t.lower()) for u in set(uris) if u and any(t and u.lower() in t.lower() for i, t in texts)}
    assert got == want and len(want) > 20
    none = spark.createDataFrame([], "uri string")
    assert citations.contained(none, spark.createDataFrame(texts, "id int, text string")).count() == 0


def test_groundedness_and_marks(spark):
    cited = spark.createDataFrame([(1, "url", "https://a.example"), (1, "citation", "12/34"), (1, "citation", "12/34"), (2, "citation", "99/99"), (3, "citation", None)], "id int, kind string, uri string")
    texts = spark.createDataFrame([(7, "see 12/34."), (8, "see HTTPS://A.EXAMPLE/x")], "id int, text string")
    assert [tuple(r) for r in citations.groundedness(cited, texts).orderBy("id").collect()] == [(1, 2, 0, True), (2, 0, 1, False)]
    answers = spark.createDataFrame([(1, "12/34"), (2, "99/99 and 99/99"), (4, None)], "id int, text string")
    assert {r.id: r.text for r in citations.marked(answers, cited, texts).collect()} == {1: "12/34", 2: "99/99 [unverified] and 99/99 [unverified]", 4: None}


def test_packing_of_lines_and_paragraphs(spark):
    def brute(lines, most, carry):
        out, first = [], 0
        for i in range(len(lines)):
            if i > first and sum(map(len, lines[first : i + 1])) > most:
                out.append("\n".join(lines[first:i]))
                first = max(first, i - carry)
        return [*out, "\n".join(lines[first:])]

    rng = random.Random(4)
    rows = [(i, "\n".join("x" * rng.randint(0, 12) for _ in range(rng.randint(1, 30))), rng.randint(5, 40), rng.choice([0, 40, 80, 120])) for i in range(60)] + [(99, "", 10, 0)]
    got = spark.createDataFrame(rows, "id int, t string, most int, lap int").select("id", chunking.line_windows(F.col("t"), F.col("most"), F.col("lap")).alias("w")).collect()
    assert {r.id: r.w for r in got} == {i: brute(t.split("\n"), most, math.ceil(lap / 40)) for i, t, most, lap in rows}
    text = "before\n# a\nbody\n\n## b \n" + "\n\n".join(["p" * 30] * 5) + "\n# \n#no heading"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.sections(F.col("t"), F.lit(70)).alias("s")).first().s
    assert [(r.title, len(r.body)) for r in got] == [(None, 6), ("a", 8), ("b", 36), ("b", 62), ("b", 30), (None, 13)] or [r.title for r in got][:3] == [None, "a", "b"]
    assert "".join(re.sub(r"\s", "", r.body) for r in got) == re.sub(r"\s", "", text)


def test_declarations_by_margin(spark):
    ts = "import a from 'b'\n\nexport async function run<T> (x: T) {\n  return x\n}\n\nexport interface Shape {\n  n: number\n}\n\nrun(1)\n"
    go = "package a\n\nfunc (s *S) Run(x int) {\n\tgo f()\n}\n\ntype S struct {\n\tA int\n}\n"
    rows = [("t", "a/x.ts", ts), ("g", "m.go", go), ("p", "b.py", "@d\ndef f():\n    pass\n\nclass C:\n    x = 1\n"), ("bad", "c.py", "def (\n"), ("none", "d.ts", "run()\n")]
    got = chunking.chunk_files(spark.createDataFrame(rows, "id string, rel_path string, content string"), min_chars=5).orderBy("id", "ordinal").collect()
    assert [(r.id, r.title, r.unit_type) for r in got] == [("bad", "c.py", "symbol"), ("g", "m.go › Run", "symbol"), ("g", "m.go › S", "definition"), ("none", "d.ts", "code"), ("p", "b.py › f", "symbol"), ("p", "b.py › C", "symbol"), ("t", "a/x.ts › run", "symbol"), ("t", "a/x.ts › Shape", "definition")]
    assert got[-2].text.rstrip().endswith("}") and "import" not in got[-2].text


def test_web_search_and_rerank(spark):
    docs = [(1, "A red fox", "jumps over the dog"), (2, None, "red dogs; the fox"), (3, "fox", "red-fox the"), (4, "x", None), (5, "red", "fox")]
    corpus = spark.createDataFrame(docs, "doc_id int, title string, text string")
    asked = spark.createDataFrame([("all", "fox red"), ("phrase", '"red fox"'), ("not", "fox -dog"), ("both", 'red -"the fox"'), ("only", "-fox"), ("blank", " "), ("null", None)], "query_id string, text string")
    got: dict = {}
    for r in retrieval.web_match(corpus, asked).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got == {"all": {1, 2, 3, 5}, "phrase": {1, 3, 5}, "not": {2, 3, 5}, "both": {1, 3, 5}}

    @F.pandas_udf("double")
    def longest(q: pd.Series, p: pd.Series) -> pd.Series:
        return p.str.len().astype(float)

    body = spark.createDataFrame([(i, "p", "word " * i) for i in range(1, 40)], "doc_id int, project string, text string")
    fused = body.select(F.lit("q").alias("query_id"), "doc_id", "project", F.lit(0.5).alias("dense"), F.lit(1.0).alias("sparse"), (1.0 / F.col("doc_id")).alias("rrf"))
    q = spark.createDataFrame([("q", "word")], "query_id string, text string")
    top = retrieval.rerank(fused, body, q, 3, longest, *retrieval.RERANK).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [9, 8, 7] and {r.tier for r in top} == {"high"}  # of the first nine
    plain = retrieval.rerank(fused, body, q, 3).orderBy("rank").collect()
    assert [r.doc_id for r in plain] == [1, 2, 3] and {r.score for r in plain} == {1.0}
    rows = spark.createDataFrame([(5.0, "rerank", ["a"]), (1.0, "rerank", ["a", "b"]), (1.0, "rerank", ["a", "a"]), (-1.0, "rerank", []), (0.6, "cosine", None), (0.1, "cosine", ["a", "b"])], "score double, scale string, signals array<string>")
    assert [r.tier for r in retrieval.loose_tiers(rows).collect()] == ["high", "high", "medium", "low", "high", "medium"]


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x[3] = 0
    df = spark.createDataFrame([(f"v{i:02d}", [float(f) for f in v], "g") for i, v in enumerate(x)], "id string, vec array<double>, g string")
    for metric in ("cosine", "ip", "l2"):
        got: dict = {}
        for r in retrieval.nearest_in_blocks(df, df, 3, "g", 16, 16, metric).collect():
            got.setdefault(int(r.query_id[1:]), set()).add(int(r.id[1:]))
        for i in range(40):
            s = {"cosine": lambda: x @ x[i] / np.where((n := np.linalg.norm(x, axis=1) * np.linalg.norm(x[i])) > 0, n, 1), "ip": lambda: x @ x[i], "l2": lambda: -np.linalg.norm(x - x[i], axis=1)}[metric]()
            others = [j for j in range(40) if j != i and not (metric == "cosine" and j == 3)]
            assert got[i] == set(sorted(others, key=lambda j: (-round(s[j], 6), j))[:3])
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.normalise(F.col("v")).alias("n")).collect()
    assert v[0].n == [0.6, 0.8] and v[1].n == [None, None]


RES = "id long, intent_id string, response_excerpt string, outcome string, score double, grader string, graded boolean"


def test_memory_merges(spark):
    rows = [(1, "a", "old", "resolved", 0.9, "h", True), (2, "a", None, "unknown", 0.0, "h", False), (3, "a", "kept", "unknown", 0.1, "h", True), (4, "b", "", "unknown", None, None, None)]
    df = spark.createDataFrame(rows, RES)
    assert {r.intent_id: r.id for r in memory.picked(df).collect()} == {"a": 2, "b": 4}
    grades = spark.createDataFrame([("a", "RESOLVED ", 7.0, "user", "x" * 700), ("b", "odd", None, "user", None), ("c", "partial", -1.0, "user", "new")], "intent_id string, outcome string, score double, grader string, excerpt string")
    got = {r.id: r for r in memory.graded(df, grades).collect()}
    assert (got[2].outcome, got[2].score, got[2].graded, len(got[2].response_excerpt)) == ("resolved", 1.0, True, 600)
    assert (got[4].outcome, got[4].score, got[4].graded) == ("unknown", 0.0, True) and got[1].grader == "h" and got[3].response_excerpt == "kept"
    new = [r for i, r in got.items() if i > 4]
    assert [(r.intent_id, r.outcome, r.score, r.response_excerpt) for r in new] == [("c", "partial", 0.0, "new")]
    texts = spark.createDataFrame([("a", "answer"), ("b", "answer"), ("z", "none"), ("b", None)], "intent_id string, text string")
    assert {r.id: r.response_excerpt for r in memory.attached(df, texts).collect()} == {1: "old", 2: None, 3: "kept", 4: "answer"}
    assert memory.graded(df.limit(0), grades).count() == 3 and memory.picked(df.limit(0)).count() == 0


def test_record_and_recall(spark):
    store = "id string, intent_text string, frequency long, first_seen timestamp, last_seen timestamp, first_session string, last_session string"
    known = spark.createDataFrame([("reset dev database",)], "t string").select(T.intent_key(F.array_join(T.intent_terms("t"), " ")).alias("k")).first().k
    stored = spark.createDataFrame([(known, "reset dev database", 3, None, None, "s0", "s0")], store)
    turns = spark.createDataFrame([("please reset the dev database " + "!" * 600, "s1", "2026-01-02"), ("hi", "s2", "2026-01-03"), (None, "s3", None), ("list open issues", "s2", None)], "text string, session string, d string").withColumn("at", F.to_timestamp("d"))
    got = {r.id: r for r in memory.record(stored, turns).collect()}
    assert len(got) == 2 and got[known].frequency == 4 and len(got[known].intent_text) == 500 and got[known].last_session == "s1" and got[known].first_session in ("s0", "s1")
    intents = spark.createDataFrame([("i1", "reset dev database now", "p"), ("i2", "reset the dev database", "q"), ("i3", "reset dev cluster database", "p"), ("i4", "", "p"), ("i5", None, None)], "id string, text string, project string")
    asked = spark.createDataFrame([("q1", "please reset dev database", "p"), ("q2", None, "p"), ("q3", "reset dev database", None)], "id string, text string, project string")
    res = spark.createDataFrame([(1, "i2", "x", "resolved", 0.5, "h", True), (2, "i2", "y", "resolved", 0.5, "h", True), (3, "i3", "", "resolved", 0.9, "h", True)], RES)
    got = memory.recall_scoped(intents, res, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score, r.own, r.best) for r in got] == [("q1", "i1", 1.0, True, None), ("q1", "i3", 0.75, True, None), ("q3", "i1", 1.0, False, None), ("q3", "i2", 1.0, False, 2)]
    notes = {r.intent_id: r.text for r in memory.injections(intents.withColumn("frequency", F.lit(2)), res, 12).collect()}
    assert notes["i2"].startswith("Asked before (2x): reset") and notes["i2"].endswith("\n+ y") and "\n" not in notes["i1"]


def test_space_places_new_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 6)) * [5, 3, 2, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "id int, vec array<double>")
    space = graph.Space(df, 6.0, (1.0, 0.0, 0.0))
    p = np.array([[r.x - 1, r.y, r.z] for r in space.place(df).orderBy("id").collect()])
    assert abs(np.abs(p).max() - 6) < 1e-3 and p.var(0)[0] >= p.var(0)[1] >= p.var(0)[2]
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.abs((x - x.mean(0)) @ vt[:3].T)
    assert np.allclose(np.abs(p), want * 6 / want.max(), atol=1e-3)
    again = space.place(df.where("id = 7").withColumn("id", F.lit(70))).first()
    assert np.allclose([again.x - 1, again.y, again.z], p[7], atol=1e-3)
    assert {tuple(r) for r in graph.Space(df.limit(3)).place(df.limit(2)).select("x", "y", "z").collect()} == {(0.0, 0.0, 0.0)}
    nodes, edges = graph.single_graph(df.withColumns({"document": F.col("id") % 3, "source": F.lit(1)}), 10, 99)
    assert nodes.count() == 50 and max(r.degree for r in graph.degrees(edges).collect()) >= 6
    assert graph.attached(df.limit(0), df).count() == 0


def test_skew_join_equals_the_plain_one(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(None, 1), ("cold", 2), ("alone", 3)], "k string, x int")
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c"), (None, "d")], "k string, y string")
    for how in ("inner", "left"):
        assert sorted(map(str, skew.skew_join(left, right, "k", how, rows=50).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    assert skew.hot_keys(left, "k", 50) == {"hot": 6}
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "hint" in plan(small(left)).lower() and "hint" not in plan(small(left, 10)).lower()


def test_delivered_again_adds_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    b = spark.createDataFrame([("s", 0, "b", "2026-01-02"), ("s", 0, "a", "2026-01-01"), ("s", 1, "c", None)], "session_id string, seq int, id string, created_at string")
    for _ in range(2):
        tail.append_new(b, out, ["session_id", "seq"], "created_at")
    assert sorted((r.seq, r.id) for r in spark.read.parquet(out).collect()) == [(0, "a"), (1, "c")]


def test_history_as_messages(spark):
    rows = spark.createDataFrame([("f", 3, "hi", "/srv/a", None), ("f", 4, "yo", "/srv/a/x", "2026-01-01")], "path string, line int, text string, project string, d string").withColumn("at", F.to_timestamp("d"))
    projects = spark.createDataFrame([("p", "/srv/a"), ("n", None)], "id string, root_path string")
    got = {r.seq: r for r in history_messages(rows, projects).collect()}
    assert got[3].project_id == "p" and got[3].created_at is not None and got[4].project_id is None and got[4].role == "user"
