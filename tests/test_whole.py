"""The whole job: what earlier versions left out."""

from pyspark.sql import functions as F

from quarry.operators import graph, memory, retrieval
from quarry.plans import catalog, files

ALIASES = [("user", "user"), ("human", "user"), (" Asker", "user"), ("bot", "assistant"), ("function", "tool")]


def test_every_spelling_of_a_role_and_session_counts(spark):
    aliases = spark.createDataFrame(ALIASES, "alias string, role string")
    rows = [
        ("1", "s", "user", 0, "reset dev database"), ("2", "S", " Human ", 3, "list open issues"), ("3", "s", "asker", 6, "thanks, works"),
        ("4", "s", "BOT", 1, "done"), ("5", "s", "function", 4, "output"), ("6", "s", "narrator", 7, "left out"), ("7", "s", None, 9, "left out"), ("8", None, "human", 0, "reset dev database"),
    ]
    df = spark.createDataFrame(rows, "id string, session_id string, role string, seq int, text string").withColumn("created_at", F.current_timestamp())
    assert {r.normalized: r.frequency for r in memory.recorded(df, aliases).collect()} == {"reset dev database": 2, "list open issues": 1, "works": 1}
    assert [(r.session_id, r.seq, r.outcome) for r in memory.graded_turns(df, aliases).orderBy("seq").collect()] == [("s", 0, "resolved"), ("s", 3, "resolved")]
    assert sum(r.turns for r in catalog.intent_grades(df, aliases).collect()) == 2
    assert [tuple(r) for r in files.prompt_pairs(df, aliases).orderBy("seq").collect()] == [("s", 3, 0), ("s", 6, 3)]
    assert {r.role: r.turns for r in files.transcript_messages(df, aliases).collect()} == {"user": 3, "assistant": 1, "tool": 1}


def test_graph_has_the_links_of_every_row(spark):
    rows = [(i, [float((i * 7) % 11) - 5, float((i * 3) % 5) - 2.5, 1.0], i % 2) for i in range(1, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = set()
    for i, v, g in rows:
        want |= {(min(i, j), max(i, j)) for _, j in sorted((-round(cos(v, w), 6), j) for j, w, h in rows if h == g and j != i)[:3]}
    assert {(r.a, r.b) for r in catalog.knn_links(df).collect()} == want
    assert {r.node: r.degree for r in graph.degrees(catalog.knn_links(df)).collect()} == {i: sum(i in e for e in want) for i, _, _ in rows}


def test_products_of_a_large_group_spread(spark):
    rows = [(i, [float((i * 7) % 11) - 5, float((i * 3) % 5) - 2.5, 1.0], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g int")
    near = retrieval.nearest_in_blocks(df, df, 3, "g", rows_per_block=4, queries_per_block=40)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\nWindow ") + plan.count("- Window ") <= 1  # of ranks; none over all rows of a group
    assert "((g#" in plan.split("MapInPandas")[1] and " AND (b#" in plan.split("MapInPandas")[1].split("\n", 3)[2]
    got = {(r.query_id, r["rank"]): r.id for r in near.collect()}
    whole = retrieval.nearest_in_blocks(df, df, 3, "g").collect()
    assert got == {(r.query_id, r["rank"]): r.id for r in whole} and len(got) == 120
