"""Search: lexical and dense legs, fusion by reciprocal rank, confidence. All queries of a batch run in one plan.

A corpus is (doc_id, project, text), queries are (query_id, text). Ties go to the smaller id. Null and blank texts are
never found. Scores are rounded before they are ranked, so that ranks do not depend on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vector import term_sign, term_slot
from quarry.session import BROADCAST_ROWS, small

RRF_K, TOPK = 60, 8
K1, B = 1.2, 0.75
#: Confidence by cosine: high from, medium from.
HIGH, MEDIUM = 0.55, 0.40
#: The same on the scale of a reranking model.
RERANK = (4.0, 0.0)


def _terms(df: DataFrame, key: list[str]) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return df.where("text is not null").select(*key, F.explode(words).alias("term"))


def _query_terms(queries: DataFrame) -> DataFrame:
    return _terms(queries, ["query_id"]).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def sparse_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, project, sparse): BM25 over unstemmed terms, any term may match."""
    tf = _terms(corpus, ["doc_id", "project"]).groupBy("doc_id", "project", "term").agg(F.count("*").alias("tf"))
    sizes = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    whole = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = _query_terms(queries)
    hint = F.broadcast if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda d: d  # terms of the queries bound all three
    hits = tf.join(hint(wanted.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(sizes, "doc_id").join(hint(df), "term").join(F.broadcast(whole))  # a row for the whole corpus
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    per = scored.withColumn("w", weight).join(hint(wanted), "term")
    return per.groupBy("query_id", "doc_id", "project").agg(F.round(F.sum("w"), 6).alias("sparse"))


def dense_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, project, dense): cosine of hashed bags of words; only positive ones."""
    slots = lambda df, key, n: df.groupBy(*key, term_slot(F.col("term")).alias("slot")).agg(F.sum(term_sign(F.col("term")) * n).alias("x"))
    docs = slots(_terms(corpus, ["doc_id", "project"]), ["doc_id", "project"], F.lit(1))
    asked = slots(_query_terms(queries), ["query_id"], F.col("qtf"))
    asked = asked.join(asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("qn")), "query_id").where("qn > 0")
    both = docs.withColumn("d2", F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id"))).join(small(asked.withColumnRenamed("x", "y")), "slot")
    sums = both.groupBy("query_id", "doc_id", "project").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.first("d2").alias("d2"), F.first("qn").alias("qn"))
    return sums.where("s > 0").select("query_id", "doc_id", "project", F.round(F.col("s") / F.sqrt("d2") / F.col("qn"), 6).alias("dense"))


def leg(scores: DataFrame, score: str, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each group with their ranks from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, doc_id, project, dense, sparse, rrf) of two ranked legs: one union, one shuffle."""
    one = lambda df, mine, other: df.select("query_id", "doc_id", "project", F.col(mine), F.lit(None).cast("double").alias(other), "rank")
    legs = one(dense, "dense", "sparse").unionByName(one(sparse, "sparse", "dense"))
    rrf = F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9)
    return legs.groupBy("query_id", "doc_id", "project").agg(F.coalesce(F.max("dense"), F.lit(0.0)).alias("dense"), F.coalesce(F.max("sparse"), F.lit(0.0)).alias("sparse"), rrf.alias("rrf"))


def finalize(fused: DataFrame, topk: int = TOPK) -> DataFrame:
    """The topk of each query with rank, agreement (any of the first three found by both legs) and confidence tier."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id")
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)
    every = Window.partitionBy("query_id")
    agree = F.max(((F.col("rank") <= 3) & (F.col("dense") > 0) & (F.col("sparse") > 0)).cast("int")).over(every) == 1
    best = F.max(F.when(F.col("rank") == 1, F.col("dense"))).over(every)
    tier = F.when((best >= HIGH) | ((best >= MEDIUM) & agree), "high").when((best >= MEDIUM) | agree, "medium").otherwise("low")
    return top.withColumn("agreement", agree).withColumn("tier", tier)


def search(corpus: DataFrame, queries: DataFrame, topk: int = TOPK, project: str | None = None) -> DataFrame:
    """Hybrid search of all queries over one corpus, or one project of it; each leg gives 4 x topk. An unknown project finds nothing."""
    corpus = corpus if project is None else corpus.where(F.col("project") == project)
    return finalize(fuse(leg(dense_scores(corpus, queries), "dense", 4 * topk), leg(sparse_scores(corpus, queries), "sparse", 4 * topk)), topk)


def search_global(corpus: DataFrame, queries: DataFrame, topk: int = TOPK) -> DataFrame:
    """Hybrid search over all projects: each leg gives 2 x topk per project, then all are merged."""
    by = ("query_id", "project")
    return finalize(fuse(leg(dense_scores(corpus, queries), "dense", 2 * topk, by), leg(sparse_scores(corpus, queries), "sparse", 2 * topk, by)), topk)


def tiers(score: Column, agree: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    """Confidence of a best score: high from `high`, or from `medium` if the legs agree; medium from there or if they agree."""
    return F.when((score >= high) | ((score >= medium) & agree), "high").when((score >= medium) | agree, "medium").otherwise("low")


def loose_tiers(rows: DataFrame) -> DataFrame:
    """Rows (score, scale, signals) with their tier; scale `rerank` has the thresholds of a reranker, others those of cosines. Two signals agree."""
    agree = F.size(F.array_distinct("signals")) >= 2
    return rows.withColumn("tier", F.when(F.col("scale") == "rerank", tiers(F.col("score"), agree, *RERANK)).otherwise(tiers(F.col("score"), agree)))


def claim_recall(query: Column, passage: Column) -> Column:
    """Share of the query's claim terms that the passage has: the scorer where no model is at hand."""
    q = T.claim_terms(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.claim_terms(passage))) / F.size(q)).otherwise(0.0)


def rerank(fused: DataFrame, corpus: DataFrame, queries: DataFrame, topk: int = TOPK, scorer: Callable[[Column, Column], Column] = claim_recall, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """(query_id, rank, doc_id, project, dense, sparse, rrf, score, agreement, tier): the second stage over the first max(3 topk, topk) fused hits.

    `scorer` gives a score of query and passage: an expression, or a pandas UDF around a model (whose thresholds are then
    RERANK). It replaces the order; ties keep the fused one. Only pool rows meet their texts.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id")
    pool = fused.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(3 * topk, topk))
    texts = corpus.select("doc_id", "project", F.col("text").alias("__p"))
    scored = pool.join(texts, ["doc_id", "project"]).join(queries.select("query_id", F.col("text").alias("__q")), "query_id").withColumn("score", F.round(scorer(F.col("__q"), F.col("__p")), 6))
    second = Window.partitionBy("query_id").orderBy(F.desc("score"), "__r")
    top = scored.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= topk)
    every = Window.partitionBy("query_id")
    agree = F.max(((F.col("rank") <= 3) & (F.col("dense") > 0) & (F.col("sparse") > 0)).cast("int")).over(every) == 1
    best = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(every)
    return top.withColumn("agreement", agree).withColumn("tier", tiers(best, agree, high, medium)).select("query_id", "rank", "doc_id", "project", "dense", "sparse", "rrf", "score", "agreement", "tier")


def web_match(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents (doc_id, title, text) that a web search (query_id, text) takes: all words and "phrases", none of the -words and -"phrases".

    Title and text are searched together, in lower case, by runs of letters and digits. Candidates have all of a query's
    words by their postings; only these are looked through for phrases and exclusions. A query of exclusions only finds nothing.
    """
    part = "-?\"[^\"]*\"|[^\\s\"]+"
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    said = lambda t: F.concat(F.lit(" "), F.array_join(words(t), " "), F.lit(" "))
    parts = F.regexp_extract_all("text", F.lit(part), F.lit(0))
    some = lambda keep: F.filter(F.transform(F.filter(parts, keep), said), lambda p: F.length(p) > 2)
    asked = queries.where("text is not null").select("query_id", some(lambda p: ~p.startswith("-")).alias("yes"), some(lambda p: p.startswith("-")).alias("no"))
    asked = asked.withColumn("must", F.array_distinct(F.flatten(F.transform("yes", lambda p: F.split(F.trim(p), " "))))).where(F.size("yes") > 0)
    wanted = asked.select("query_id", F.size("must").alias("n"), F.explode("must").alias("word"))
    docs = corpus.select("doc_id", F.explode(F.array(words(F.concat_ws(" ", "title", "text")))).alias("w"))
    postings = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(wanted, "word")
    full = postings.groupBy("query_id", "doc_id").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m = n").select("query_id", "doc_id")
    near = full.join(docs.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("all")), "doc_id").join(asked.select("query_id", "yes", "no"), "query_id")
    fits = F.forall("yes", lambda p: F.contains(F.col("all"), p)) & ~F.exists("no", lambda p: F.contains(F.col("all"), p))
    return near.where(fits).select("query_id", "doc_id").distinct()


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, k: int, group: str, rows_per_block: int = 4096, queries_per_block: int = 512, metric: str = "cosine") -> DataFrame:
    """(query_id, id, group, cosine, rank): exact k nearest rows of each query in its group, both (id, group, vec). metric may be
    cosine, ip (inner product) or l2 (the column is then the distance, taken negative). Vectors without length are never near by cosine.

    Rows and queries are packed into blocks; each block of rows meets each block of queries of its group, as one
    product of matrices. Each query block goes once to every row block of its group, so products of a large group spread
    over tasks. A query never finds itself. Equal cosines go to the smaller id.
    """

    def packed(df: DataFrame, size: int, prefix: str) -> tuple[DataFrame, DataFrame]:
        blocks = df.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("blocks"))
        numbered = df.join(small(blocks), group).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
        return numbered.groupBy(group, "b").agg(F.collect_list(F.struct("id", "vec")).alias(f"{prefix}s")), blocks

    stored, blocks = packed(rows, rows_per_block, "row")
    asked, _ = packed(queries, queries_per_block, "query")
    copies = asked.drop("b").join(small(blocks), group).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    pairs = stored.join(copies, [group, "b"])

    def product(frames):
        for f in frames:
            for _, p in f.iterrows():
                r, q = p["rows"], p["querys"]
                ids, x = np.array([v["id"] for v in r]), np.array([v["vec"] for v in r], dtype=np.float64)
                qi, y = np.array([v["id"] for v in q]), np.array([v["vec"] for v in q], dtype=np.float64)
                if metric == "cosine":
                    long_x, long_y = (np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
                    g = (y / np.where(long_y > 0, long_y, 1)) @ (x / np.where(long_x > 0, long_x, 1)).T
                    g[:, long_x[:, 0] == 0] = -np.inf
                elif metric == "ip":
                    g = y @ x.T
                else:
                    g = -np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * y @ x.T, 0))
                g = np.round(g, 6)
                g[qi[:, None] == ids[None]] = -np.inf
                for i in range(len(qi)):
                    best = np.lexsort((ids, -g[i]))[:k]
                    best = best[g[i][best] > -np.inf]
                    yield pd.DataFrame({"query_id": qi[i], "id": ids[best], group: p[group], "cosine": g[i][best]})

    of = lambda df, c: df.schema[c].dataType.simpleString()
    near = pairs.mapInPandas(product, f"query_id {of(queries, 'id')}, id {of(rows, 'id')}, {group} {of(rows, group)}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
