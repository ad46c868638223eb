"""The whole job: what earlier versions left out of the training-data operators."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quarry.llm import conversations, neighbours, pairs


def test_near_copies_take_bounded_memory():
    rng = np.random.default_rng(0)
    x = rng.normal(size=384) + 0.15 * rng.normal(size=(2500, 384))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    tracemalloc.start()
    r, c, cosine = neighbours.best(x[:512], x, 11, 0.9)  # all pairs are above 0.9: 10 GB before
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    exact = x[:512].astype(np.float64) @ x.T.astype(np.float64)
    assert exact.min() > 0.9
    for i in range(512):
        assert set(c[r == i]) == set(np.argsort(-exact[i])[:11])
    r, c, cosine = neighbours.best(x[:1].repeat(5, 0), x[:1].repeat(40_000, 0), 11, 0.9)  # ties at the bar
    assert np.bincount(r).tolist() == [11] * 5 and np.allclose(cosine, 1)
    assert not len(neighbours.best(x[:3], -x, 11, 0.9)[0])


def test_probed_share_does_not_fall_with_the_number_of_vectors():
    for n in (40_000, 1_000_000, 4_200_000, 50_000_000):
        for reach in (neighbours.REACH, neighbours.CLOSE_REACH):
            most, wanted = neighbours.budget(n, reach)
            assert most <= neighbours.BLOCK_MOST and wanted >= int(n * reach / 16)


def test_late_rows_meet_their_session_and_too_late_ones_do_not(spark, tmp_path):
    aliases = spark.createDataFrame([("user", "user"), ("bot", "assistant")], "alias string, role string")
    schema = spark.createDataFrame([], "id string, session_id string, role string, seq int, text string, created_at timestamp").schema
    source, root = f"{tmp_path}/in", f"{tmp_path}/run"

    def arrive(*rows):
        df = spark.createDataFrame([(f"{s}{i}", s, r, i, t, f"2026-01-01 {at}:00") for s, i, r, t, at in rows], "id string, session_id string, role string, seq int, text string, at string")
        df.select("id", "session_id", "role", "seq", "text", F.col("at").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(source)
        conversations.advance(spark, f"{source}/*.parquet", schema, aliases, root, "1 hour", "30 minutes")
        return {r.session: r.kept for r in conversations.judged(spark, root).collect()}

    assert arrive(("a", 0, "user", "one", "10:00"), ("c", 0, "user", "two", "10:05")) == {}  # all open
    # an hour behind the last event is still in time; the last row takes the watermark past the others
    seen = arrive(("a", 1, "bot", "reply", "10:10"), ("b", 0, "user", "late", "09:30"), ("b", 1, "bot", "late reply", "09:31"), ("x", 0, "user", "open", "14:00"))
    assert seen == {"a": True, "b": True, "c": False}
    seen = arrive(("c", 1, "bot", "too late", "10:15"), ("d", 0, "user", "too late", "09:00"), ("y", 0, "user", "open", "14:10"))
    assert seen == {"a": True, "b": True, "c": False}
    # a session that goes on after a pause is judged again
    seen = arrive(("a", 2, "user", "more", "15:00"), ("z", 0, "user", "push", "20:00"))
    assert seen == {"a": False, "b": True, "c": False, "x": False, "y": False}
    turns = conversations.rebuilt(spark, root).orderBy("session_id", "turn").collect()
    assert [(r.session_id, r.turn, r.role, r.text) for r in turns] == [("b", 0, "user", "late"), ("b", 1, "assistant", "late reply")]


def test_copies_of_slices_answer_alike(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"v{i:03d}", [float(f) for f in v]) for i, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "embedding_id string, embedding array<float>")
    one = {(r.id, r.neighbour) for r in neighbours.nearest(df, k=5, dim=8, centroids=4).collect()}
    monkeypatch.setattr(neighbours, "QUERIES_MOST", 150)
    assert neighbours.copies(200, 2048, 4096, 1) > 2
    assert {(r.id, r.neighbour) for r in neighbours.nearest(df, k=5, dim=8, centroids=4).collect()} == one and len(one) == 1000
    monkeypatch.undo()
    for n in (40_000, 1_000_000, 50_000_000):
        most, wanted = neighbours.budget(n, neighbours.REACH)
        slices = -(-n // most)
        assert (wanted + 2 * n / slices) / neighbours.copies(n, most, wanted, slices) <= neighbours.QUERIES_MOST


def test_languages_are_learned_from_all_texts_and_pairs(spark, monkeypatch):
    word = lambda n, end: F.concat(F.translate(F.lpad(n.cast("int").cast("string"), 6, "0"), "0123456789", "abcdefghij"), F.lit(end))
    told = lambda l, en, de: F.when(l == "en", F.array(*map(F.lit, en))).otherwise(F.array(*map(F.lit, de)))
    lang = F.when(F.col("id") % 2 == 0, "en").otherwise("de")
    # 12,000 texts; of 24,000 words each is in six texts of one language
    rare = [F.when(F.col("lang") == "en", word(n, "en")).otherwise(word(n, "de")) for n in (F.floor(F.col("id") / 12) * 12 + j for j in range(12))]
    texts = spark.range(12_000).withColumn("lang", lang).select("id", "lang", F.concat_ws(" ", told(F.col("lang"), ["the", "page", "end"], ["das", "ist", "seite"]), *rare).alias("text"))
    # 40,000 pairs; of their own words each is in six pairs of one language
    said = spark.range(40_000).withColumn("lang", lang)
    own = F.when(F.col("lang") == "en", word(F.floor(F.col("id") / 12), "answered")).otherwise(word(F.floor(F.col("id") / 12), "geantwortet"))
    every = said.select(F.col("id").alias("resolution_id"), told(F.col("lang"), ["the", "page"], ["das", "seite"]).alias("asked"), F.concat(told(F.col("lang"), ["the", "end"], ["das", "ist"]), F.array(own)).alias("spoken"))
    asked = F.array(F.lit("the"), F.lit("page")).alias("asked")
    k = F.col("id")
    of_texts = spark.range(20).select(k + 50_000, asked, F.array(*[word(k * 600 + 588 + j, "de") for j in range(3)]))  # the last group of texts too
    of_pairs = spark.range(20).select(k + 60_000, asked, F.array(*[word(k * 50 + j, "geantwortet") for j in range(3)]))
    df = every.union(of_texts).union(of_pairs).withColumn("wanted", F.lit(None).cast("string"))
    wrong = {n + i for n in (50_000, 60_000) for i in range(20)}
    assert {r[0] for r in pairs.other_language(df, texts).collect()} == wrong
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 10)  # words too many to be broadcast
    assert {r[0] for r in pairs.other_language(df, texts).collect()} == wrong


def test_words_of_texts_are_those_of_pairs(spark, monkeypatch):
    odd = [
        "the page, the page.", "a-b-c x-1 y²z-w ²q-r", "/etc/x a_b 12 v2 é e\u0301a ß İ ΑΣ", "say “no thing” or «rien du» or \"not this\" and “open", "x ```code\nmore``` y ```tail", "",
        "one\u00a0two3 four\u2003five\x0bsix\x1cseven\u2028eight", "Ⅷ½abc 中文字 𝒳y 𝟙z", "l’eau d'or -a- --b a--b", "\"", " \n\t",
    ]
    rows = [(f"l{i}", t) for i, t in enumerate(odd)] + [("all", t) for t in odd]
    df = spark.createDataFrame(rows, "l string, text string")
    plain = {(r.l, r.word): r["count"] for r in df.select("l", F.explode(F.array_distinct(pairs._spoken(F.col("text")))).alias("word")).groupBy("l", "word").count().collect()}
    lower = df.select("l", F.lower("text").alias("text"))
    assert {(r.l, r.word): r.n for r in lower.mapInArrow(pairs._counted, "l string, word string, n long").groupBy("l", "word").agg(F.sum("n").alias("n")).collect()} == plain
    monkeypatch.setattr(pairs, "KEPT", 3)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in lower.collect()])
    sums = {}
    for b in pairs._counted(iter([batch, batch])):
        for r in b.to_pylist():
            sums[r["l"], r["word"]] = sums.get((r["l"], r["word"]), 0) + r["n"]
    assert sums == {k: 2 * n for k, n in plain.items()}


def test_runs_are_looked_up_once_a_piece(monkeypatch):
    looked = []

    class Words(pairs._Words):
        def __getitem__(self, run):
            looked.append(run)
            return super().__getitem__(run)

    monkeypatch.setattr(pairs, "_Words", Words)
    batch = pa.RecordBatch.from_pylist([{"l": "en" if i % 2 else "de", "text": f"the page, the page a-b “not this” n{i % 5} x_y " * 20} for i in range(500)])
    every = [r for b in pairs._counted(iter([batch])) for r in b.to_pylist()]
    assert {(r["l"], r["word"], r["n"]) for r in every} == {(x, w, 250) for x in ("de", "en") for w in ("the", "page")} and len(every) == 4
    assert len(looked) == 11  # 70,000 before


def test_contexts_are_counted_in_pieces(spark, monkeypatch):
    rows = [None, [], ["a"], ["."], ["a", "."], ["a", "b"], [".", ".", "."], ["a", ",", "b", "c", "."], ["^", "x", "y", "z"], ["a", "b", "c", "d", ".", "e", "f", "g", "h"], [";", "a", "b", ":"]]
    seen, ends = {}, {}
    for k in rows:
        for i in range(len(k or ()) - 1):
            if k[i] not in ".,;:":
                at = [k[i - j] if i >= j else "^" for j in range(4)]
                for c in (f"1 {at[0]}", f"2 {at[1]} {at[0]}", "3" if {"^", "."} & {*at[1:3]} else f"3 {at[3]} {at[2]}"):
                    seen[c], ends[c] = seen.get(c, 0) + 1, ends.get(c, 0) + (k[i + 1] == ".")
    for piece in (1, 50, 8_000_000):
        monkeypatch.setattr(pairs, "PIECE", piece)
        got = {}
        for part in (rows, rows[3:], []):
            for b in pairs._ends(iter([pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["k"])])):
                for r in b.to_pylist():
                    s, e = got.get(r["c"], (0, 0))
                    got[r["c"]] = s + r["seen"], e + r["ends"]
        assert got == {c: (2 * n, 2 * ends[c]) for c, n in seen.items()}  # the first three rows have no contexts


def test_only_templates_of_enough_words_are_aligned(monkeypatch):
    aligned = []
    monkeypatch.setattr(pairs, "_common", lambda a, b, f=pairs._common: aligned.append(1) or f(a, b))
    refusals = pairs._Refusals()
    assert refusals.only("Sorry for the delay. I’m sorry, but I can’t help with that! I hope you understand.") and not refusals.only("I hope you understand.")
    aligned.clear()
    assert not refusals.only("The links move together with this page. " * 50 + "I can’t do that in the second run, as nothing is lost there.")
    assert len(aligned) < 10  # 1,224 before


def test_placeholders_may_be_long_and_wrapped(spark):
    longest = max(pairs.PLACEHOLDERS, key=lambda p: len(p.replace(" ", "")))
    texts = [longest, longest.upper(), f"```\n{longest}\n```" + " ." * 300, longest + "x", " -\n" * 200, "n" + "/" * 300 + "a", "İ" * 20, None, "", "n a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, answer string")
    assert [r[0] for r in df.orderBy("id").select(pairs._empty(F.col("answer"))).collect()] == [True, True, True, False, True, True, False, True, True, False]
