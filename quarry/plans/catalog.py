"""The registered queries of the core: name, Spark plan, comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, citations, graph, memory, retrieval
from quarry.operators.skew import skew_join
from quarry.operators.snapshot import append_absent, latest, upsert
from quarry.plans import files, knowledge, oracle, streams
from quarry.session import table
from quarry.streaming import tail

Query = Callable[[SparkSession, str], DataFrame]
DOCUMENT_KEY = ["project_id", "source_id", "rel_path"]


def _over(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])


def _sql(text: str) -> Query:
    """A relational query over the tables behind its FROM and JOIN; array positions count from 1."""
    text = re.sub(r"(\w+)\[(\d)\]", r"element_at(\1, \2)", text)
    names = [n for n in oracle.TABLES if re.search(rf"(?i)\b(?:from|join)\s+{n}\b", text)]
    for n in names:
        text = re.sub(rf"(?i)\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", text)
    return lambda spark, sf_dir: spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def _current(docs: DataFrame) -> DataFrame:
    return latest(docs, DOCUMENT_KEY, "created_at", [F.xxhash64("content"), "id"])


def chunk_char_windows(docs: DataFrame) -> DataFrame:
    w = chunking.char_windows(docs, "doc_id", "text")
    return w.select("doc_id", "ordinal", "start", F.length("text").alias("n_chars"), T.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"))


def doc_content_dedup(docs: DataFrame) -> DataFrame:
    body = F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " "))
    return docs.where("text is not null").groupBy(F.sha2(body, 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def hash_diff_changed(docs: DataFrame) -> DataFrame:
    """Files that are absent from the older snapshot (rows before 2025-07-01) or differ from it in content."""
    cut = F.to_timestamp(F.lit("2025-07-01"))
    old = _current(docs.where(F.col("created_at") < cut)).select(*DOCUMENT_KEY, F.sha2(F.coalesce("content", F.lit("")), 256).alias("old"))
    new = _current(docs).select("id", *DOCUMENT_KEY, F.sha2(F.coalesce("content", F.lit("")), 256).alias("new"))
    both = new.join(old, DOCUMENT_KEY, "left")
    return both.where("old is null or old <> new").select("id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("state"))


def doc_upsert_snapshot(docs: DataFrame) -> DataFrame:
    cut = F.to_timestamp(F.lit("2025-07-01"))
    stored, fresh = _current(docs.where(F.col("created_at") < cut)), _current(docs.where((F.col("created_at") >= cut) | F.col("created_at").isNull()))
    merged = upsert(stored, fresh, DOCUMENT_KEY)
    return merged.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"))


def vector_upsert(rows: DataFrame) -> DataFrame:
    once = latest(rows, ["space_id", "content_hash"], "created_at", ["embedding_id"])
    return once.select("space_id", "content_hash", "token_count", F.size(F.coalesce("embedding", F.array().cast("array<float>"))).alias("dim"))


def message_append(messages: DataFrame) -> DataFrame:
    keyed = messages.where("session_id is not null and seq is not null").select(F.lower("session_id").alias("session_id"), "seq", "created_at")
    cut = F.to_timestamp(F.lit("2025-12-01"))
    all_rows = append_absent(keyed.where(F.col("created_at") < cut).dropDuplicates(["session_id", "seq"]), keyed.where(F.col("created_at") >= cut), ["session_id", "seq"])
    return all_rows.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"))


def unit_types(docs: DataFrame) -> DataFrame:
    now = _current(docs).where("content is not null")
    typed = now.select(T.strategy(F.col("rel_path")).alias("strategy"), T.unit_type(F.col("content"), F.col("rel_path")).alias("unit_type"))
    return typed.groupBy("strategy", "unit_type").agg(F.count("*").alias("files"))


def _chunks(docs: DataFrame, projects: DataFrame) -> DataFrame:
    now = _current(docs).select("id", "project_id", "rel_path", "content")
    return chunking.chunk_files(now.join(chunking.chunk_settings(projects), "project_id", "left"))


def doc_spine(docs: DataFrame) -> DataFrame:
    """Pairs of consecutive windows of a document."""
    w = chunking.char_windows(docs, "doc_id", "text")
    follow = F.lead("ordinal").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return w.select("doc_id", F.col("ordinal").alias("a"), follow.alias("b")).where("b is not null")


def _search_inputs(docs: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.select("doc_id", F.coalesce("project", F.lit("")).alias("project"), "text"), areas.select(F.col("subject").alias("query_id"), F.col("description").alias("text"))


def hybrid_search(docs: DataFrame, areas: DataFrame) -> DataFrame:
    return retrieval.search(*_search_inputs(docs, areas)).select("query_id", "rank", "doc_id", "dense", "sparse", "rrf", "agreement", "tier")


def hybrid_search_global(docs: DataFrame, areas: DataFrame) -> DataFrame:
    return retrieval.search_global(*_search_inputs(docs, areas)).select("query_id", "rank", "project", "doc_id", "dense", "sparse", "rrf", "tier")


def sparse_topk(docs: DataFrame, areas: DataFrame) -> DataFrame:
    return retrieval.leg(retrieval.sparse_scores(*_search_inputs(docs, areas)), "sparse", 8).select("query_id", "rank", "doc_id", "sparse")


def signal_summary(docs: DataFrame, areas: DataFrame) -> DataFrame:
    top = retrieval.search(*_search_inputs(docs, areas))
    d, s = F.col("dense") > 0, F.col("sparse") > 0
    return top.groupBy("query_id").agg(F.count_if(d).alias("dense"), F.count_if(s).alias("lexical"), F.count_if(d & s).alias("both"), F.count("*").alias("total"))


def _near(rows: DataFrame, k: int, every: bool) -> DataFrame:
    v = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return retrieval.nearest_in_blocks(v, v if every else v.where("id % 50 = 0"), k, "label")


def dense_topk(rows: DataFrame) -> DataFrame:
    return _near(rows, 8, False).select("query_id", "id", "cosine", "rank")


def knn_links(rows: DataFrame) -> DataFrame:
    """The neighbour graph: every row's links to its three nearest of its label."""
    return graph.links(_near(rows, 3, True))


def _refs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(T.references(F.col(text))).alias("r")).select(key, "r.kind", "r.uri")


def extract_refs(docs: DataFrame) -> DataFrame:
    return _refs(_current(docs), "id", "content").groupBy("kind", "uri").agg(F.countDistinct("id").alias("files"))


def citation_verdicts(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many of the references of current files are verified: in the text of a document, or the address or title of a file, verbatim."""
    cited = _refs(_current(docs), "id", "content").distinct()
    texts = corpus.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(docs.select("id", F.concat_ws(" ", "url", "title").alias("text")))
    told = cited.join(citations.verdicts(cited, texts).select("kind", "uri", "verified"), ["kind", "uri"])
    return told.groupBy("kind").agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))


def claim_support(resolutions: DataFrame, intents: DataFrame) -> DataFrame:
    """Each intent's text as a claim against its answers: the best recall of its terms; the first answer wins ties."""
    claims = latest(intents, ["id"], "last_seen", [F.xxhash64("intent_text")]).select(F.col("id").alias("intent_id"), T.claim_terms(F.col("intent_text")).alias("c"))
    answers = resolutions.where("response_excerpt is not null").select("intent_id", F.col("id").alias("rid"), T.claim_terms(F.col("response_excerpt")).alias("a"))
    score = F.when(F.size("c") > 0, F.size(F.array_intersect("c", "a")) / F.size("c")).otherwise(0.0)
    best = skew_join(answers, claims, "intent_id").withColumn("score", score).groupBy("intent_id").agg(F.max(F.struct("score", (-F.col("rid")).alias("r"))).alias("b"))
    s = T.half_up(F.col("b.score"), 3)
    return best.select("intent_id", s.alias("score"), (F.col("b.score") >= 0.3).alias("supported"), F.when(F.col("b.score") > 0, -F.col("b.r")).otherwise(-1).alias("answer"))


def budget_assembly(docs: DataFrame, budget: int = 2000) -> DataFrame:
    """Per project the first texts, newest first, that fit the budget; repeated texts once, the first always.

    Each text costs a token at least, so no more than `budget` rows of a project can be in: others go before the sum.
    """
    rows = docs.where("text is not null and project is not null").select("project", "doc_id", "ingested_at", F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")).alias("sig"), "text")
    order = [F.desc_nulls_last("ingested_at"), F.asc("doc_id")]
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("project", "sig").orderBy(*order))).where("n = 1")
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("r") <= budget)
    cum = F.sum(T.token_estimate(F.col("text"))).over(Window.partitionBy("project").orderBy("r"))
    return first.withColumn("used", cum).where((F.col("used") <= budget) | (F.col("r") == 1)).select("project", "r", "doc_id", "used")


def query_intents(intents: DataFrame) -> DataFrame:
    kind = T.query_intent(F.col("intent_text"))
    w = T.layer_weights(kind)
    return intents.groupBy(kind.alias("intent"), w["scoped"].alias("scoped"), w["shared"].alias("shared")).agg(F.count("*").alias("n"))


def intent_recall(intents: DataFrame) -> DataFrame:
    rows = latest(intents, ["id"], "last_seen", [F.xxhash64("intent_text")]).select("id", F.col("intent_text").alias("text"))
    asked = rows.where(F.conv(F.substring("id", -2, 2), 16, 10).cast("int") % 50 == 0)
    return memory.recall(rows, asked)


def intent_grades(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    return memory.graded_turns(messages, aliases).groupBy("outcome", "score").agg(F.count("*").alias("turns"))


def bundled_positions(rows: DataFrame) -> DataFrame:
    """Three components of each vector pulled toward the centroids of its label and of a quarter of all ids."""
    x = F.col("embedding")
    return graph.bundled(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("document"), (F.col("vec_id") % 4).alias("source"), *[x[i].cast("double").alias(c) for i, c in enumerate("xyz")]))


def pca_positions(rows: DataFrame) -> DataFrame:
    return graph.positions(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "message").schema
    rows = tail.tail_messages(spark, f"{sf_dir}/message.parquet*", schema)
    return rows.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"))


def _events(e: DataFrame) -> DataFrame:
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def asof_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Of each customer's order the order before it, as of its date: one window instead of a range join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = orders.withColumn("before", F.lag("o_orderkey").over(w)).where("before is not null")
    lines = items.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    return before.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "before", F.coalesce("lines", F.lit(0)).alias("lines"))


def approx_parts(items: DataFrame) -> DataFrame:
    return items.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def queries() -> dict[str, Query]:
    return {
        "chunk_char_windows": _over(chunk_char_windows, "documents"),
        "chunk_files": _over(_chunks, "kb_document", "kb_project"),
        "doc_content_dedup": _over(doc_content_dedup, "documents"),
        "hash_diff_changed": _over(hash_diff_changed, "kb_document"),
        "doc_upsert_snapshot": _over(doc_upsert_snapshot, "kb_document"),
        "vector_upsert": _over(vector_upsert, "emb_minilm_384"),
        "message_append": _over(message_append, "message"),
        "unit_types": _over(unit_types, "kb_document"),
        "doc_spine": _over(doc_spine, "documents"),
        "dense_topk": _over(dense_topk, "embeddings"),
        "sparse_topk": _over(sparse_topk, "documents", "subject_area"),
        "hybrid_search": _over(hybrid_search, "documents", "subject_area"),
        "hybrid_search_global": _over(hybrid_search_global, "documents", "subject_area"),
        "signal_summary": _over(signal_summary, "documents", "subject_area"),
        "extract_refs": _over(extract_refs, "kb_document"),
        "citation_verdicts": _over(citation_verdicts, "kb_document", "documents"),
        "claim_support": _over(claim_support, "intent_resolution", "intent"),
        "budget_assembly": _over(budget_assembly, "documents"),
        "query_intents": _over(query_intents, "intent"),
        "intent_normalized": _over(memory.recorded, "message", "role_alias"),
        "intent_recall": _over(intent_recall, "intent"),
        "intent_grades": _over(intent_grades, "message", "role_alias"),
        "intent_retention": _over(lambda r: memory.retained(r).select("intent_id", "id", "score"), "intent_resolution"),
        "knn_links": _over(knn_links, "embeddings"),
        "node_degree": _over(lambda e: graph.degrees(knn_links(e)), "embeddings"),
        "bundled_positions": _over(bundled_positions, "embeddings"),
        "pca_positions": _over(pca_positions, "embeddings"),
        "spiral_layout": _over(lambda e: graph.spiral(e, "label"), "embeddings"),
        "event_windows_tumbling": _over(lambda e: tail.tumbling(_events(e)), "events"),
        "event_windows_sliding": _over(lambda e: tail.sliding(_events(e)), "events"),
        "event_windows_session": _over(lambda e: tail.sessions(_events(e)), "events"),
        "stream_tail": stream_tail,
        "asof_orders": _over(asof_orders, "orders", "lineitem"),
        "approx_parts": _over(approx_parts, "lineitem"),
    } | files.queries() | {name: _sql(text) for name, text in (oracle.SHARED | files.SHARED).items()} | knowledge.queries() | streams.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | oracle.SHARED | files.SQL | files.SHARED | knowledge.SQL | streams.SQL
