"""Registered queries over the store (current rows, ingest, chunks), search, grounding, memory and graphs; with comparison SQL written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators import chunking, citations, graph, ingest, memory, retrieval
from quarry.operators.snapshot import latest
from quarry.plans import files, oracle
from quarry.session import table
from quarry.sources.tables import page

Query = Callable[[SparkSession, str], DataFrame]
CUT = "2025-07-01"
#: Paths and names that prompts mention.
MENTION = "[A-Za-z0-9_-]+/[A-Za-z0-9_.-]*[A-Za-z0-9]"


def _over(function: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names])


def _current(docs: DataFrame) -> DataFrame:
    return latest(docs, ingest.KEY, "created_at", [F.xxhash64("content"), "id"])


def _once(rows: DataFrame, newest: str) -> DataFrame:
    return latest(rows.where("id is not null"), ["id"], newest, [F.xxhash64(*[c for c in rows.columns if c != newest])])


# --- projects and inventories, over current rows


def project_summary(projects: DataFrame, docs: DataFrame, messages: DataFrame) -> DataFrame:
    """Current files, sources and distinct messages per project, each counted before the join."""
    d = _current(docs).groupBy("project_id").agg(F.count("*").alias("documents"), F.countDistinct("source_id").alias("sources"))
    m = messages.groupBy("project_id").agg(F.countDistinct("id").alias("messages"))
    rows = projects.join(d, projects["id"] == d["project_id"], "left").drop("project_id").join(m, projects["id"] == m["project_id"], "left")
    return rows.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "sources", "messages")])


def project_status(projects: DataFrame, docs: DataFrame) -> DataFrame:
    c = _current(docs).groupBy("project_id").agg(F.count("*").alias("files"), F.count("content").alias("filled"))
    rows = projects.join(c, projects["id"] == c["project_id"], "left")
    said = F.when(F.coalesce("filled", F.lit(0)) >= F.coalesce("files", F.lit(0)), "ready").otherwise(F.concat(F.lit("filled "), F.col("filled").cast("string"), F.lit("/"), F.col("files").cast("string")))
    return rows.select("name", F.coalesce("files", F.lit(0)).alias("files"), said.alias("status"))


def project_rollup(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """All projects as one row: how many, their files and filled files, and the distinct models in order."""
    per = _current(docs).agg(F.count("*").alias("files"), F.count("content").alias("filled"))
    models = F.array_join(F.sort_array(F.collect_set("embed_model")), " · ")
    return projects.agg(F.count("*").alias("projects"), models.alias("models")).join(F.broadcast(per)).select("projects", "models", "files", "filled")


def project_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _current(table(spark, sf_dir, "kb_document")).groupBy("project_id").agg(F.count("*").alias("documents"))
    walk = """
WITH RECURSIVE t AS (
  SELECT id, name, 0 AS depth, cast(name AS STRING) AS path FROM {p} WHERE parent_id IS NULL
  UNION ALL SELECT p.id, p.name, t.depth + 1, concat(t.path, '/', p.name) FROM {p} p JOIN t ON p.parent_id = t.id
) SELECT * FROM t"""
    tree = spark.sql(walk, p=table(spark, sf_dir, "kb_project"))
    return tree.join(docs, tree["id"] == docs["project_id"], "left").select("name", "depth", "path", F.coalesce("documents", F.lit(0)).alias("documents"))


def inventory(docs: DataFrame, projects: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the current files in order; limit is put between 1 and 500, offset is at least 0."""
    rows = _current(docs).join(F.broadcast(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))), "project_id")
    page = rows.select("project", "source_id", "rel_path", F.length(F.coalesce("content", F.lit(""))).alias("chars")).orderBy("project", "source_id", "rel_path", "chars")
    return page.offset(max(0, offset)).limit(min(max(1, limit), 500))


def intent_page(intents: DataFrame, project: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of intents, of one project if given; limit is put between 1 and 200."""
    rows = _once(intents, "last_seen")
    rows = rows if project is None else rows.where(F.col("project") == project)
    return rows.select("id", "project", "frequency").orderBy(F.desc("frequency"), "id").offset(max(0, offset)).limit(min(max(1, limit), 200))


def unembedded_documents(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    rows = _current(docs).where(F.trim("content") != "").join(vectors.select("content_hash"), "content_hash", "left_anti")
    return rows.groupBy("project_id").agg(F.count("*").alias("files"))


def filled_projects(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """Projects with a filled current file, and their share of all such files."""
    per = _current(docs).where("content is not null").groupBy("project_id").agg(F.count("*").alias("filled")).where("filled > 0")
    return projects.join(per, projects["id"] == per["project_id"]).select("name", "filled")


def prompt_projects(messages: DataFrame, projects: DataFrame) -> DataFrame:
    """Prompts by the project whose root their path is, or lies below (a path guard); others have none."""
    paths = messages.where("text is not null and project_id is not null").join(projects.select(F.col("id").alias("project_id"), F.col("root_path").alias("folder")), "project_id")
    paths = paths.select("id", F.when(F.col("seq") % 3 == 0, F.concat("folder", F.lit("/src"))).when(F.col("seq") % 3 == 1, F.col("folder")).otherwise(F.concat("folder", F.lit("x"))).alias("path")).where("path is not null").distinct()
    roots = F.broadcast(projects.where("root_path is not null").select("name", "root_path"))
    exact = paths.join(roots, F.col("path") == F.col("root_path"), "left").groupBy("name").agg(F.count("*").alias("prompts"))
    below = paths.join(roots, (F.col("path") == F.col("root_path")) | (F.col("path").startswith(F.concat("root_path", F.lit("/")))), "left_semi")
    return exact.select(F.coalesce("name", F.lit("")).alias("project"), "prompts").unionByName(below.groupBy(F.lit("(allowed)").alias("project")).agg(F.count("*").alias("prompts")))


# --- ingest


def _text_files(docs: DataFrame) -> DataFrame:
    return docs.withColumn("strategy", F.lit("text"))


def _ingested(docs: DataFrame) -> tuple[ingest.Store, DataFrame]:
    """The store after the rows before CUT, then after the others; all texts cut by windows of characters."""
    chunker = lambda files: chunking.chunk_files(_text_files(files), declared=False)
    at = F.to_timestamp(F.lit(CUT))
    first, _ = ingest.ingest(ingest.empty_store(docs), docs.where(F.col("created_at") < at), V.hash_embed, chunker)
    return ingest.ingest(first, docs.where((F.col("created_at") >= at) | F.col("created_at").isNull()), V.hash_embed, chunker)


def ingest_documents(docs: DataFrame) -> DataFrame:
    return _ingested(docs)[0].documents.select("id", *ingest.KEY, "title", "content_hash", F.unix_micros("created_at").alias("created"))


def ingest_chunks(docs: DataFrame) -> DataFrame:
    return _ingested(docs)[0].chunks.select("chunk_id", "document_id", "ordinal", "content_hash", "tokens", F.length("text").alias("chars"))


def ingest_vectors(docs: DataFrame) -> DataFrame:
    rows = _ingested(docs)[0].vectors
    return rows.select("space_id", "content_hash", "token_count", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def ingest_references(docs: DataFrame) -> DataFrame:
    return _ingested(docs)[0].references.select("kind", "uri", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


def ingest_links(docs: DataFrame) -> DataFrame:
    """Links of chunks with their references' kinds and chunks' documents."""
    store = _ingested(docs)[0]
    return store.links.join(store.references, ["kind", "uri"]).join(store.chunks, "chunk_id").select("document_id", "chunk_id", "kind", "uri", "relation").distinct()


def ingest_stats(docs: DataFrame) -> DataFrame:
    return _ingested(docs)[1]


def chunk_fingerprints(docs: DataFrame) -> DataFrame:
    return ingest.fingerprints(_ingested(docs)[0].chunks)


def chunk_windows_of_files(docs: DataFrame) -> DataFrame:
    """Line windows of the current files, whatever their language."""
    files = _current(docs).select("id", "rel_path", "content", F.lit("code").alias("strategy"))
    out = chunking.chunk_files(files, max_chars=600, overlap=120, min_chars=0, prefix=False, declared=False)
    return out.select("id", "ordinal", F.sha2("text", 256).alias("hash"))


def chunk_sections(docs: DataFrame) -> DataFrame:
    """Sections of the current markdown files, none of them packed."""
    files = _current(docs).where(T.extension(F.col("rel_path")) == "md").select("id", "rel_path", "content")
    out = chunking.chunk_files(files, max_chars=10_000_000, min_chars=0, prefix=False)
    return out.select("id", "ordinal", "title", F.sha2("text", 256).alias("hash"))


def document_chunks(docs: DataFrame) -> DataFrame:
    """Each current document's chunks in order, the neighbours of each, and how many siblings it has."""
    chunks = chunking.chunk_files(_text_files(_current(docs)), declared=False)
    w, all_ = Window.partitionBy("id").orderBy("ordinal"), Window.partitionBy("id")
    return chunks.select("id", "ordinal", F.lag("ordinal").over(w).alias("before"), F.lead("ordinal").over(w).alias("after"), (F.count("*").over(all_) - 1).alias("siblings"))


# --- search


def _stored(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored vectors with the project of their document: (id, project, vec)."""
    known = docs.where("project is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("project").alias("project"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).join(known, "id")


def vector_search(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored vectors nearest to every 50th one, in its project."""
    v = _stored(docs, rows)
    return retrieval.nearest_in_blocks(v, v.where("id % 50 = 0"), 8, "project").select("query_id", "id", "project", "cosine", "rank")


def vector_distances(rows: DataFrame) -> DataFrame:
    """The three nearest by each of the other metrics, for every 50th vector in its label."""
    v = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    per = [retrieval.nearest_in_blocks(v, v.where("id % 50 = 0"), 3, "label", metric=m).select(F.lit(m).alias("metric"), "query_id", "id", F.round("cosine", 4).alias("score"), "rank") for m in ("ip", "l2")]
    return per[0].unionByName(per[1])


def _inputs(docs: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.select("doc_id", F.coalesce("project", F.lit("")).alias("project"), "text"), areas.select(F.col("subject").alias("query_id"), F.col("description").alias("text"))


def search_project(docs: DataFrame, areas: DataFrame) -> DataFrame:
    """Hybrid search inside the project with the first name."""
    corpus, asked = _inputs(docs, areas)
    first = docs.agg(F.min("project")).first()[0]
    return retrieval.search(corpus, asked, project=first).select("query_id", "rank", "doc_id", "project", "rrf", "tier")


def search_reranked(docs: DataFrame, areas: DataFrame) -> DataFrame:
    corpus, asked = _inputs(docs.dropDuplicates(["doc_id", "text", "project"]), areas)
    fused = retrieval.fuse(retrieval.leg(retrieval.dense_scores(corpus, asked), "dense", 32), retrieval.leg(retrieval.sparse_scores(corpus, asked), "sparse", 32))
    return retrieval.rerank(fused, corpus, asked).select("query_id", "rank", "doc_id", "rrf", "score", "agreement", "tier")


def search_reranked_global(docs: DataFrame, areas: DataFrame) -> DataFrame:
    corpus, asked = _inputs(docs.dropDuplicates(["doc_id", "text", "project"]), areas)
    by = ("query_id", "project")
    fused = retrieval.fuse(retrieval.leg(retrieval.dense_scores(corpus, asked), "dense", 16, by), retrieval.leg(retrieval.sparse_scores(corpus, asked), "sparse", 16, by))
    return retrieval.rerank(fused, corpus, asked).select("query_id", "rank", "project", "doc_id", "rrf", "score", "agreement", "tier")


def search_scores(docs: DataFrame, areas: DataFrame) -> DataFrame:
    """Reciprocal ranks of each query's hits between 0 and 1; all equal ones are 1."""
    top = retrieval.search(*_inputs(docs, areas))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("rrf").over(w), F.max("rrf").over(w)
    return top.select("query_id", "doc_id", F.when(hi == lo, 1.0).otherwise(F.round((F.col("rrf") - lo) / (hi - lo), 6)).alias("score"))


def web_search(docs: DataFrame, areas: DataFrame) -> DataFrame:
    """Documents that have an area's name, or a phrase of it, and not another word, as a web search says it."""
    asked = areas.select(F.col("subject").alias("query_id"), F.col("subject").alias("text")).unionByName(
        areas.select(F.concat("subject", F.lit("+")).alias("query_id"), F.concat(F.lit('"'), F.regexp_extract("description", "([A-Za-z]+)", 1), F.lit('" page -'), "subject").alias("text"))
    ).unionByName(areas.select(F.concat("subject", F.lit("!")).alias("query_id"), F.concat(F.lit('"the page" -'), "subject").alias("text")))
    return retrieval.web_match(docs.select("doc_id", "text", F.col("rel_path").alias("title")), asked)


def layer_tiers(docs: DataFrame, areas: DataFrame, projects: DataFrame) -> DataFrame:
    """Hits with the layer of their project (shared: without a parent), the layer's weight for the query, and their own tier."""
    top = retrieval.search_global(*_inputs(docs, areas))
    shared = F.broadcast(projects.where("parent_id is null").select(F.col("name").alias("project")).distinct().withColumn("shared", F.lit(True)))
    tagged = top.drop("tier").join(shared, "project", "left").withColumn("layer", F.when(F.col("shared"), "shared").otherwise("scoped"))
    asked = areas.select(F.col("subject").alias("query_id"), T.query_intent(F.col("description")).alias("kind"))
    weighed = tagged.join(F.broadcast(asked), "query_id")
    weight = F.when(F.col("layer") == "shared", T.layer_weights(F.col("kind"))["shared"]).otherwise(T.layer_weights(F.col("kind"))["scoped"])
    rows = weighed.select("query_id", "doc_id", "layer", weight.alias("weight"), F.col("dense").alias("score"), F.lit("cosine").alias("scale"), F.array_compact(F.array(F.when(F.col("dense") > 0, "dense"), F.when(F.col("sparse") > 0, "sparse"))).alias("signals"))
    return retrieval.loose_tiers(rows).select("query_id", "doc_id", "layer", "weight", "tier")


# --- grounding


def _mentions(intents: DataFrame) -> DataFrame:
    """(id, kind, uri): the paths that intents mention, and the names in front of them."""
    one = _once(intents, "last_seen").select("id", F.explode(F.regexp_extract_all("intent_text", F.lit(MENTION), F.lit(0))).alias("p"))
    return one.select("id", F.lit("path").alias("kind"), F.col("p").alias("uri")).unionByName(one.select("id", F.lit("name").alias("kind"), F.substring_index("p", "/", 1).alias("uri"))).distinct()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")


def citation_containment(intents: DataFrame, docs: DataFrame) -> DataFrame:
    return citations.verdicts(_mentions(intents), _texts(docs)).select("kind", "uri", "verified", "text_id")


def groundedness(intents: DataFrame, docs: DataFrame) -> DataFrame:
    return citations.groundedness(_mentions(intents), _texts(docs))


def annotated_intents(intents: DataFrame, docs: DataFrame) -> DataFrame:
    """Intents with a mark behind the names that no document has."""
    names = _mentions(intents).where("kind = 'name'")
    own = _once(intents, "last_seen").select("id", F.col("intent_text").alias("text"))
    return citations.marked(own, names, _texts(docs)).select("id", F.sha2("text", 256).alias("hash"))


# --- memory


def intent_record(intents: DataFrame, messages: DataFrame, aliases: DataFrame) -> DataFrame:
    turns = memory.user_turns(messages, aliases).select("text", F.col("session_id").alias("session"), F.col("created_at").alias("at"))
    out = memory.record(_once(intents, "last_seen"), turns)
    return out.select("id", "frequency", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


def intent_picked(resolutions: DataFrame) -> DataFrame:
    return memory.picked(_once(resolutions, "ts")).select("intent_id", "id", F.coalesce("graded", F.lit(False)).alias("graded"))


def _grades(resolutions: DataFrame) -> DataFrame:
    """Explicit grades for one intent in three, as a user may give them; some spelt oddly or out of range."""
    per = _once(resolutions, "ts").where("intent_id is not null").groupBy("intent_id").agg(F.count("*").alias("n"))
    return per.where("n % 3 = 0").select("intent_id", F.when(F.col("n") % 2 == 0, " Resolved").otherwise("done").alias("outcome"), (F.col("n") / 4).alias("score"), F.lit("user").alias("grader"), F.concat(F.lit("graded "), F.col("n").cast("string")).alias("excerpt"))


def intent_graded(resolutions: DataFrame) -> DataFrame:
    rows = memory.graded(_once(resolutions, "ts"), _grades(resolutions))
    return rows.select("id", "intent_id", "outcome", F.round("score", 6).alias("score"), "grader", "graded", F.sha2(F.coalesce("response_excerpt", F.lit("")), 256).alias("hash"))


def intent_attached(resolutions: DataFrame, intents: DataFrame) -> DataFrame:
    answers = _once(intents, "last_seen").select(F.col("id").alias("intent_id"), F.concat(F.lit("see "), "intent_text").alias("text"))
    rows = memory.attached(_once(resolutions, "ts"), answers)
    return rows.select("id", F.sha2(F.coalesce("response_excerpt", F.lit("")), 256).alias("hash"))


def intent_recall_scoped(intents: DataFrame, resolutions: DataFrame) -> DataFrame:
    rows = _once(intents, "last_seen").select("id", F.col("intent_text").alias("text"), "project")
    asked = rows.where(F.conv(F.substring("id", -2, 2), 16, 10).cast("int") % 50 == 0)
    return memory.recall_scoped(rows, _once(resolutions, "ts"), asked)


def intent_injections(intents: DataFrame, resolutions: DataFrame) -> DataFrame:
    rows = _once(intents, "last_seen").select("id", F.col("intent_text").alias("text"), "frequency")
    return memory.injections(rows, _once(resolutions, "ts"), 100).select("intent_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("chars"))


def last_messages(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    return memory.last_messages(messages, 8, aliases).select("session_id", "seq")


def intent_salience(intents: DataFrame) -> DataFrame:
    """Salience of intents on 2026-02-01: decays with days since they were seen, grows with their frequency."""
    age = (F.lit(1769904000000000) - F.unix_micros("last_seen")) / 86_400_000_000
    return _once(intents, "last_seen").where("last_seen is not null").select("id", F.round(0.5 * F.exp(-0.01 * age) + 0.2 * F.log(1.0 + F.col("frequency")), 6).alias("salience"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("seen"))


# --- vectors and graphs


def vector_functions(rows: DataFrame) -> DataFrame:
    """Each vector against the mean direction of its label: dot product, cosine, distance, and its length after normalisation."""
    v = F.col("embedding")
    mean = rows.groupBy("label").agg(F.array(*[F.avg(v[i].cast("double")) for i in range(64)]).alias("m"))
    x = rows.join(F.broadcast(mean), "label")
    r = lambda c: F.round(c, 5)
    return x.select("vec_id", r(V.dot(v, F.col("m"))).alias("ip"), r(V.cosine(v, F.col("m"))).alias("cosine"), r(V.l2(v, F.col("m"))).alias("l2"), r(V.norm(V.normalise(v))).alias("unit"))


def node_relations(rows: DataFrame) -> DataFrame:
    """Of every 50th node: its label's siblings, and the six nearest of them with their weights."""
    v = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    near = retrieval.nearest_in_blocks(v, v.where("id % 50 = 0"), 6, "label", metric="ip")
    size = rows.groupBy("label").agg((F.count("*") - 1).alias("siblings"))
    return near.join(F.broadcast(size), "label").select("query_id", "id", "rank", T.half_up(F.col("cosine"), 4).alias("weight"), "siblings")


def attach_links(rows: DataFrame) -> DataFrame:
    """Every 50th vector attached to the three most similar nodes of a sample of forty per label."""
    v = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    nodes = graph.sampled(v, "label", "id", 40)
    return graph.attached(v.where("id % 50 = 0").select("id", "vec"), nodes.select("id", "vec"))


def node_groups(rows: DataFrame) -> DataFrame:
    """Per label: its nodes, the sum of their ids, and the node nearest the label's mean by its strongest dimension."""
    v = F.col("embedding")
    strong = F.array_position(v, F.array_max(v)) - 1
    per = rows.select("label", "vec_id", strong.alias("dim"), F.array_max(v).alias("top"))
    best = per.groupBy("label", "dim").agg(F.max(F.struct("top", (-F.col("vec_id")).alias("v"))).alias("b"), F.count("*").alias("nodes"))
    return best.select("label", "dim", (-F.col("b.v")).alias("strongest"), "nodes")


def cluster_support(rows: DataFrame, floor: float = 0.55, pad: float = 0.2) -> DataFrame:
    """How far each label reaches from its mean along each axis, both ways; at least the floor, and a pad on top."""
    at = rows.select("label", F.posexplode("embedding").alias("axis", "x"))
    mean = at.groupBy("label", "axis").agg(F.avg(F.col("x").cast("double")).alias("m"), F.max(F.col("x").cast("double")).alias("hi"), F.min(F.col("x").cast("double")).alias("lo"))
    reach = lambda d: F.round(F.greatest(F.lit(floor), d) + pad, 5)
    return mean.select("label", "axis", reach(F.col("hi") - F.col("m")).alias("ahead"), reach(F.col("m") - F.col("lo")).alias("behind"))


def graph_positions(rows: DataFrame) -> DataFrame:
    """Spread of all vectors along each fitted axis, what of it the axis before has, and the greatest reach."""
    space = graph.Space(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    p = space.place(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    one = p.agg(*[F.var_pop(c).alias(f"v{c}") for c in "xyz"], F.max(F.greatest(*[F.abs(F.col(c)) for c in "xyz"])).alias("top"))
    return one.select((F.col("vx") >= F.col("vy")).alias("xy"), (F.col("vy") >= F.col("vz")).alias("yz"), F.round("top", 2).alias("top"))


def graph_bundled(rows: DataFrame) -> DataFrame:
    """Fitted positions pulled toward the centroids of label and source."""
    space = graph.Space(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    placed = space.place(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("document"), (F.col("label") % 3).alias("source")), "id")
    return graph.bundled(placed)


def graph_single(rows: DataFrame) -> DataFrame:
    """The links of one graph of up to 400 nodes over all labels."""
    v = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("document"), (F.col("label") % 3).alias("source"), F.col("embedding").alias("vec"))
    return graph.single_graph(v)[1]


# --- columns of text


def text_columns(docs: DataFrame) -> DataFrame:
    """One line, symbol and highlights of current files, and both estimates of their tokens."""
    body = F.regexp_replace("content", "\\A[ \\t\\n\\r]+|[ \\t\\n\\r]+\\z", "")
    trimmed = F.when(body == "", 0).otherwise(T.token_estimate(body))
    marks = F.regexp_count(T.highlight(F.col("content"), "the page a"), F.lit("<mark>"))
    return _current(docs).where("content is not null").select("id", F.sha2(T.oneline(F.col("content")), 256).alias("line"), F.coalesce(T.symbol_name(F.col("content")), F.lit("")).alias("symbol"), T.token_estimate(F.col("content")).alias("tokens"), trimmed.cast("long").alias("trimmed"), marks.cast("long").alias("marks"))


def queries() -> dict[str, Query]:
    return {
        "project_summary": _over(project_summary, "kb_project", "kb_document", "message"),
        "project_status": _over(project_status, "kb_project", "kb_document"),
        "project_rollup": _over(project_rollup, "kb_project", "kb_document"),
        "project_tree": project_tree,
        "doc_inventory": _over(inventory, "kb_document", "kb_project"),
        "doc_inventory_page": _over(lambda d, p: inventory(d, p, 9999, 100), "kb_document", "kb_project"),
        "intent_page": _over(lambda i: intent_page(i, None, 0, -5), "intent"),
        "intent_page_scoped": _over(lambda i: intent_page(i, "", 999, 3), "intent"),
        "table_page": _over(lambda o: page(o, ["O_OrderKey", "o_orderstatus", "o_totalprice"], "o_totalprice > 100000 and o_orderstatus <> 'F'", "o_totalprice", True, 20, 5), "orders"),
        "search_project": _over(search_project, "documents", "subject_area"),
        "unembedded_documents": _over(unembedded_documents, "kb_document", "emb_minilm_384"),
        "filled_projects": _over(filled_projects, "kb_project", "kb_document"),
        "prompt_projects": _over(prompt_projects, "message", "kb_project"),
        "ingest_documents": _over(ingest_documents, "kb_document"),
        "ingest_chunks": _over(ingest_chunks, "kb_document"),
        "ingest_vectors": _over(ingest_vectors, "kb_document"),
        "ingest_references": _over(ingest_references, "kb_document"),
        "ingest_links": _over(ingest_links, "kb_document"),
        "ingest_stats": _over(ingest_stats, "kb_document"),
        "chunk_fingerprints": _over(chunk_fingerprints, "kb_document"),
        "chunk_lines": _over(chunk_windows_of_files, "kb_document"),
        "chunk_sections": _over(chunk_sections, "kb_document"),
        "document_chunks": _over(document_chunks, "kb_document"),
        "vector_search": _over(vector_search, "documents", "embeddings"),
        "vector_distances": _over(vector_distances, "embeddings"),
        "search_reranked": _over(search_reranked, "documents", "subject_area"),
        "search_reranked_global": _over(search_reranked_global, "documents", "subject_area"),
        "search_scores": _over(search_scores, "documents", "subject_area"),
        "web_search": _over(web_search, "documents", "subject_area"),
        "layer_tiers": _over(layer_tiers, "documents", "subject_area", "kb_project"),
        "citation_containment": _over(citation_containment, "intent", "documents"),
        "groundedness": _over(groundedness, "intent", "documents"),
        "annotated_intents": _over(annotated_intents, "intent", "documents"),
        "intent_record": _over(intent_record, "intent", "message", "role_alias"),
        "intent_picked": _over(intent_picked, "intent_resolution"),
        "intent_graded": _over(intent_graded, "intent_resolution"),
        "intent_attached": _over(intent_attached, "intent_resolution", "intent"),
        "intent_recall_scoped": _over(intent_recall_scoped, "intent", "intent_resolution"),
        "intent_injections": _over(intent_injections, "intent", "intent_resolution"),
        "last_messages": _over(last_messages, "message", "role_alias"),
        "intent_salience": _over(intent_salience, "intent"),
        "vector_functions": _over(vector_functions, "embeddings"),
        "node_relations": _over(node_relations, "embeddings"),
        "attach_links": _over(attach_links, "embeddings"),
        "node_groups": _over(node_groups, "embeddings"),
        "cluster_support": _over(cluster_support, "embeddings"),
        "graph_positions": _over(graph_positions, "embeddings"),
        "graph_bundled": _over(graph_bundled, "embeddings"),
        "graph_single": _over(graph_single, "embeddings"),
        "text_columns": _over(text_columns, "kb_document"),
    }


_CUR = oracle._CURRENT
_ONE_INTENT = "i AS (SELECT * FROM intent QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST) = 1)"
_ONE_ANSWER = "r AS (SELECT * FROM intent_resolution WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST) = 1)"
_TRIM = "regexp_replace({t}, '^[\\s\\x{{0B}}]+|[\\s\\x{{0B}}]+$', '', 'g')"
_KEY = f"'i' || substr(sha256(array_to_string({oracle._intent_terms('{t}')}, ' ')), 1, 30)"

#: The current files, cut into windows of 1,500 characters that step by 1,350; pieces under 200 go unless they are alone.
_PIECES = f"""
{_CUR}, w AS (
  SELECT id, created_at, content, rel_path, o, greatest(0, ceil((length(c) - 1500) / 1350.0))::BIGINT + 1 AS n, {_TRIM.format(t="substring(c, o * 1350 + 1, 1500)")} AS b
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(c) - 1500) / 1350.0))::BIGINT + 1)) AS o FROM (SELECT *, replace(content, chr(0), '') AS c FROM cur WHERE content IS NOT NULL))),
k AS (SELECT id, created_at, rel_path, content, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS ordinal, CASE WHEN rel_path <> '' AND NOT starts_with(b, rel_path) THEN rel_path || chr(10) || chr(10) || b ELSE b END AS text
  FROM w WHERE length(b) >= 200 OR n = 1),
c AS (SELECT *, sha256(text) AS h FROM k),
ch AS (SELECT *, substr(sha256(id || '/' || ordinal::VARCHAR || '/' || h), 1, 32) AS chunk_id FROM c)"""
_BEFORE = f"TIMESTAMPTZ '{CUT} 00:00:00+00'"
#: What an ingest in two steps stores: of each key the state of the first step if the second brings none or an equal one.
_STATES = f"""
a AS (SELECT * FROM kb_document WHERE created_at < {_BEFORE} QUALIFY row_number() OVER (PARTITION BY project_id, source_id, rel_path ORDER BY created_at DESC) = 1),
b AS (SELECT * FROM kb_document WHERE created_at >= {_BEFORE} OR created_at IS NULL QUALIFY row_number() OVER (PARTITION BY project_id, source_id, rel_path ORDER BY created_at DESC NULLS LAST) = 1)"""


def _mention_sql() -> str:
    return f"m AS (SELECT id, unnest(regexp_extract_all(intent_text, '{MENTION}')) AS p FROM i), refs AS (SELECT DISTINCT id, 'path' AS kind, p AS uri FROM m UNION SELECT DISTINCT id, 'name', string_split(p, '/')[1] FROM m)"


_VERDICT = f"""{_ONE_INTENT}, {_mention_sql()}, u AS (SELECT DISTINCT uri FROM refs),
v AS (SELECT u.uri, min(d.doc_id) AS text_id FROM u JOIN documents d ON contains(lower(d.text), lower(u.uri)) GROUP BY 1)"""
_ONELINE = "substr(trim(regexp_replace({t}, '[\\s\\x{{0B}}]+', ' ', 'g')), 1, {n})"
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_TERMS = "list_distinct(regexp_extract_all(lower({t}), '[0-9]+(?:[/:.\\-][0-9]+)+|[A-Za-z0-9_]+'))"


def _reranked(by: str, k: int, columns: str) -> str:
    legs = oracle._fused(by, k)
    legs = legs[: legs.index("\nt AS (")].rstrip().rstrip(",")
    return (
        legs
        + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS r0 FROM f QUALIFY r0 <= 24),
x AS (SELECT DISTINCT doc_id, coalesce(project, '') AS project, text FROM documents),
s AS (SELECT p.*, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, {_TERMS.format(t="coalesce(x.text, '')")})) / len(q) ELSE 0 END, 6) AS score
  FROM p JOIN x USING (doc_id, project) JOIN (SELECT subject AS query_id, {_TERMS.format(t="description")} AS q FROM subject_area) USING (query_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM s QUALIFY rank <= 8),
g AS (SELECT query_id, bool_or(rank <= 3 AND dense > 0 AND sparse > 0) AS agreement, max(CASE WHEN rank = 1 THEN score END) AS best FROM t GROUP BY 1)
SELECT {columns}, agreement, CASE WHEN best >= 0.55 OR best >= 0.4 AND agreement THEN 'high' WHEN best >= 0.4 OR agreement THEN 'medium' ELSE 'low' END AS tier FROM t JOIN g USING (query_id)"""
    )


SQL = {
    "project_summary": f"""
WITH {_CUR} SELECT name, (SELECT count(*) FROM cur WHERE project_id = p.id) AS documents, (SELECT count(DISTINCT source_id) FROM cur WHERE project_id = p.id) AS sources,
  (SELECT count(DISTINCT id) FROM message WHERE project_id = p.id) AS messages FROM kb_project p""",
    "project_status": f"""
WITH {_CUR}, x AS (SELECT name, (SELECT count(*) FROM cur WHERE project_id = p.id) AS files, (SELECT count(*) FROM cur WHERE project_id = p.id AND content IS NOT NULL) AS filled FROM kb_project p)
SELECT name, files, CASE WHEN filled >= files THEN 'ready' ELSE 'filled ' || filled || '/' || files END AS status FROM x""",
    "project_rollup": f"""
WITH {_CUR} SELECT (SELECT count(*) FROM kb_project) AS projects, (SELECT string_agg(m, ' · ' ORDER BY m) FROM (SELECT DISTINCT embed_model AS m FROM kb_project)) AS models, count(*) AS files, count(content) AS filled FROM cur""",
    "project_tree": f"""
WITH RECURSIVE {_CUR}, t AS (SELECT id, name, 0 AS depth, name AS path FROM kb_project WHERE parent_id IS NULL
  UNION ALL SELECT p.id, p.name, t.depth + 1, t.path || '/' || p.name FROM kb_project p JOIN t ON p.parent_id = t.id)
SELECT name, depth, path, (SELECT count(*) FROM cur WHERE project_id = t.id) AS documents FROM t""",
    "doc_inventory": f"""
WITH {_CUR} SELECT p.name AS project, source_id, rel_path, length(coalesce(content, '')) AS chars FROM cur JOIN kb_project p ON p.id = project_id ORDER BY ALL LIMIT 200""",
    "doc_inventory_page": f"""
WITH {_CUR} SELECT p.name AS project, source_id, rel_path, length(coalesce(content, '')) AS chars FROM cur JOIN kb_project p ON p.id = project_id ORDER BY ALL LIMIT 500 OFFSET 100""",
    "intent_page": f"WITH {_ONE_INTENT} SELECT id, project, frequency FROM i ORDER BY frequency DESC, id LIMIT 1",
    "intent_page_scoped": f"WITH {_ONE_INTENT} SELECT id, project, frequency FROM i WHERE project = '' ORDER BY frequency DESC, id LIMIT 200 OFFSET 3",
    "table_page": """
SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F') AS total FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'
ORDER BY o_totalprice DESC, o_orderkey, o_orderstatus LIMIT 20 OFFSET 5""",
    "search_project": oracle._fused("query_id", 32).replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND project = (SELECT min(project) FROM documents)") + " SELECT query_id, rank, doc_id, project, rrf, tier FROM h",
    "unembedded_documents": f"""
WITH {_CUR} SELECT project_id, count(*) AS files FROM cur WHERE trim(content) <> '' AND content_hash NOT IN (SELECT content_hash FROM emb_minilm_384 WHERE content_hash IS NOT NULL) GROUP BY 1""",
    "filled_projects": f"WITH {_CUR} SELECT name, count(content) AS filled FROM kb_project p JOIN cur ON cur.project_id = p.id GROUP BY p.id, name HAVING count(content) > 0",
    "prompt_projects": """
WITH p AS (SELECT DISTINCT m.id, CASE seq % 3 WHEN 0 THEN root_path || '/src' WHEN 1 THEN root_path ELSE root_path || 'x' END AS path FROM message m JOIN kb_project k ON k.id = m.project_id WHERE text IS NOT NULL),
q AS (SELECT * FROM p WHERE path IS NOT NULL)
SELECT coalesce(name, '') AS project, count(*) AS prompts FROM q LEFT JOIN kb_project ON path = root_path GROUP BY name
UNION ALL SELECT '(allowed)', count(*) FROM q WHERE EXISTS (SELECT 1 FROM kb_project k WHERE q.path = root_path OR starts_with(q.path, root_path || '/'))""",
    "ingest_documents": f"""
WITH {_STATES}, h AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.rel_path, b.rel_path) AS rel_path,
  b.id IS NOT NULL AND (a.id IS NULL OR coalesce(a.content, '') <> coalesce(b.content, '')) AS came, a.title AS t, b.title AS u, coalesce(a.content, '') AS x, coalesce(b.content, '') AS y, a.created_at AS p, b.created_at AS q
  FROM a FULL JOIN b ON a.project_id = b.project_id AND a.source_id = b.source_id AND a.rel_path = b.rel_path)
SELECT id, project_id, source_id, rel_path, CASE WHEN came THEN u ELSE t END AS title, sha256(replace(CASE WHEN came THEN y ELSE x END, chr(0), '')) AS content_hash, epoch_us(coalesce(p, q)) AS created FROM h""",
    "ingest_chunks": f"""WITH {_PIECES} SELECT chunk_id, id AS document_id, ordinal::INT AS ordinal, h AS content_hash, greatest(1, floor(length(text) / 4 + 0.5))::BIGINT AS tokens, length(text) AS chars FROM ch""",
    "ingest_stats": f"""
WITH {_PIECES}, {_STATES}, n AS (SELECT b.id FROM b LEFT JOIN a ON a.project_id = b.project_id AND a.source_id = b.source_id AND a.rel_path = b.rel_path WHERE a.id IS NULL OR coalesce(a.content, '') <> coalesce(b.content, ''))
SELECT (SELECT count(*) FROM b) AS files, (SELECT count(*) FROM n) AS changed, (SELECT count(*) FROM ch WHERE id IN (SELECT id FROM n)) AS chunks,
  (SELECT count(DISTINCT h) FROM ch WHERE id IN (SELECT id FROM n) AND regexp_matches(text, '\\S') AND h NOT IN (SELECT h FROM ({{old}}))) AS embedded""",
    "chunk_fingerprints": f"WITH {_PIECES} SELECT id AS document_id, count(*) AS chunks, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM ch GROUP BY 1",
    "chunk_lines": rf"""
WITH RECURSIVE {_CUR}, l AS (SELECT id, i, sum(length(t)) OVER (PARTITION BY id ORDER BY i) AS p1, sum(length(t)) OVER (PARTITION BY id ORDER BY i) - length(t) AS p0 FROM (
  SELECT id, unnest(string_split(c, chr(10))) AS t, unnest(range(len(string_split(c, chr(10))))) AS i FROM (SELECT id, replace(content, chr(0), '') AS c FROM cur WHERE content IS NOT NULL))),
w AS (SELECT id, i, 0::BIGINT AS first, NULL::BIGINT AS a FROM l WHERE i = 0
  UNION ALL SELECT l.id, l.i, CASE WHEN l.i > w.first AND l.p1 - s.p0 > 600 THEN greatest(w.first, l.i - 3) ELSE w.first END, CASE WHEN l.i > w.first AND l.p1 - s.p0 > 600 THEN w.first END
  FROM w JOIN l ON l.id = w.id AND l.i = w.i + 1 JOIN l s ON s.id = w.id AND s.i = w.first),
z AS (SELECT id, a, i AS b FROM w WHERE a IS NOT NULL UNION ALL SELECT id, arg_max(first, i), max(i) + 1 FROM w GROUP BY id)
SELECT z.id, (row_number() OVER (PARTITION BY z.id ORDER BY b) - 1)::INT AS ordinal, sha256({_TRIM.format(t="array_to_string(string_split(replace(content, chr(0), ''), chr(10))[a + 1 : b], chr(10))")}) AS hash FROM z JOIN cur USING (id)""",
    "chunk_sections": rf"""
WITH {_CUR}, l AS (SELECT id, unnest(string_split(c, chr(10))) AS t, unnest(range(len(string_split(c, chr(10))))) AS i FROM (SELECT id, replace(content, chr(0), '') AS c FROM cur WHERE content IS NOT NULL AND lower(rel_path) LIKE '%.md')),
g AS (SELECT id, i, t, sum(CASE WHEN regexp_matches(t, '^#{{1,6}}[^\S\n]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS s FROM l),
x AS (SELECT id, s, {_TRIM.format(t="string_agg(t, chr(10) ORDER BY i)")} AS b, {_TRIM.format(t="regexp_extract(arg_min(t, i), '^#{{1,6}}[^\\S\\n]+(.*)', 1)").replace("{{1,6}}", "{1,6}")} AS h FROM g GROUP BY id, s)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INT AS ordinal, nullif(h, '') AS title, sha256(b) AS hash FROM x WHERE b <> ''""",
    "document_chunks": f"WITH {_PIECES} SELECT id, ordinal::INT AS ordinal, (lag(ordinal) OVER w)::INT AS before, (lead(ordinal) OVER w)::INT AS after, count(*) OVER (PARTITION BY id) - 1 AS siblings FROM ch WINDOW w AS (PARTITION BY id ORDER BY ordinal)",
    "vector_search": """
WITH d AS (SELECT doc_id AS id, min(project) AS project FROM documents WHERE project IS NOT NULL GROUP BY 1), v AS (SELECT vec_id AS id, project, embedding::DOUBLE[] AS e FROM embeddings JOIN d ON id = vec_id),
s AS (SELECT a.id AS query_id, b.id, a.project, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.project = b.project AND a.id <> b.id WHERE a.id % 50 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s QUALIFY rank <= 8""",
    "vector_distances": f"""
WITH s AS (SELECT unnest(['ip', 'l2']) AS metric, a.vec_id AS query_id, b.vec_id AS id, unnest([round({_DOT.format(a="a.embedding", b="b.embedding")}, 6), -round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)]) AS x
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT metric, query_id, id, round(x, 4) AS score, row_number() OVER (PARTITION BY metric, query_id ORDER BY x DESC, id) AS rank FROM s QUALIFY rank <= 3""",
    "search_reranked": _reranked("query_id", 32, "query_id, rank, doc_id, rrf, score"),
    "search_reranked_global": _reranked("query_id, project", 16, "query_id, rank, project, doc_id, rrf, score"),
    "search_scores": oracle._fused("query_id", 32)
    + " SELECT query_id, doc_id, CASE WHEN max(rrf) OVER w = min(rrf) OVER w THEN 1.0 ELSE round((rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w), 6) END AS score FROM h WINDOW w AS (PARTITION BY query_id)",
    "web_search": r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(rel_path || ' ' || coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS a FROM documents),
q AS (SELECT lower(subject) AS s, lower(regexp_extract(description, '([A-Za-z]+)', 1)) AS f, subject FROM subject_area)
SELECT DISTINCT subject AS query_id, doc_id FROM q JOIN d ON contains(a, ' ' || s || ' ')
UNION ALL SELECT DISTINCT subject || '+', doc_id FROM q JOIN d ON contains(a, ' ' || f || ' ') AND contains(a, ' page ') AND NOT contains(a, ' ' || s || ' ')
UNION ALL SELECT DISTINCT subject || '!', doc_id FROM q JOIN d ON contains(a, ' the page ') AND NOT contains(a, ' ' || s || ' ')""",
    "layer_tiers": oracle._fused("query_id, project", 16)
    + f""", k AS (SELECT subject AS query_id, regexp_matches(description, '(?i)\\b(?:{T.SCOPED})\\b') AS own, regexp_matches(description, '(?i)\\b(?:{T.SHARED})\\b') AS common FROM subject_area),
y AS (SELECT h.*, CASE WHEN project IN (SELECT name FROM kb_project WHERE parent_id IS NULL) THEN 'shared' ELSE 'scoped' END AS layer, CASE WHEN own AND NOT common THEN 0.8 WHEN common AND NOT own THEN 0.2 ELSE 0.5 END AS w FROM h JOIN k USING (query_id))
SELECT query_id, doc_id, layer, round(CASE layer WHEN 'scoped' THEN w ELSE 1 - w END, 6)::DOUBLE AS weight,
  CASE WHEN dense >= 0.55 OR dense >= 0.4 AND dense > 0 AND sparse > 0 THEN 'high' WHEN dense >= 0.4 OR dense > 0 AND sparse > 0 THEN 'medium' ELSE 'low' END AS tier FROM y""",
    "citation_containment": f"WITH {_VERDICT} SELECT DISTINCT kind, refs.uri AS uri, v.text_id IS NOT NULL AS verified, v.text_id FROM refs LEFT JOIN v ON v.uri = refs.uri",
    "groundedness": f"WITH {_VERDICT} SELECT id, count(*) FILTER (v.uri IS NOT NULL) AS verified, count(*) FILTER (v.uri IS NULL) AS unverified, count(*) FILTER (v.uri IS NULL) = 0 AS grounded FROM refs LEFT JOIN v ON v.uri = refs.uri GROUP BY id",
    "intent_record": f"""
WITH {_ONE_INTENT}, {oracle._MESSAGES}, t AS (SELECT array_to_string({oracle._intent_terms("text")}, ' ') AS n, substr(text, 1, 500) AS x, session_id AS s, created_at AS c FROM msg WHERE {oracle._USER}),
u AS (SELECT 'i' || substr(sha256(n), 1, 30) AS id, x, 1 AS f, c AS p, c AS q FROM t WHERE n <> ''),
v AS (SELECT id, count(*) AS f, min(p) AS p, max(q) AS q FROM u GROUP BY id), w AS (SELECT id, f, p, q FROM v UNION ALL SELECT id, frequency, first_seen, last_seen FROM i)
SELECT id, sum(f)::BIGINT AS frequency, min(epoch_us(p)) AS first_seen, max(epoch_us(q)) AS last_seen FROM w GROUP BY id""",
    "ingest_references": f"""
WITH {_PIECES}, {_STATES}, e AS (SELECT a.* FROM a UNION ALL SELECT b.* FROM b LEFT JOIN a ON a.project_id = b.project_id AND a.source_id = b.source_id AND a.rel_path = b.rel_path WHERE a.id IS NULL OR coalesce(a.content, '') <> coalesce(b.content, '')),
x AS (SELECT id, created_at, r.kind AS kind, r.uri AS uri FROM (SELECT id, created_at, unnest({oracle._REFS.format(t="text")}) AS r FROM ({{every}}) y)
  UNION ALL SELECT id, created_at, 'module', unnest({{imports}}) FROM e WHERE content IS NOT NULL)
SELECT kind, uri, min(epoch_us(created_at)) AS first_seen, max(epoch_us(created_at)) AS last_seen FROM x GROUP BY ALL""",
    "intent_picked": f"WITH {_ONE_ANSWER} SELECT intent_id, id, coalesce(graded, false) AS graded FROM r WHERE intent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY coalesce(graded, false), id DESC) = 1",
    "intent_graded": f"""
WITH {_ONE_ANSWER}, n AS (SELECT intent_id, count(*) AS n FROM r WHERE intent_id IS NOT NULL GROUP BY 1 HAVING count(*) % 3 = 0),
p AS (SELECT id, n FROM (SELECT * FROM r WHERE intent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY coalesce(graded, false), id DESC) = 1) x JOIN n USING (intent_id))
SELECT r.id, intent_id, CASE WHEN n IS NULL THEN outcome WHEN n % 2 = 0 THEN 'resolved' ELSE 'unknown' END AS outcome, round(CASE WHEN n IS NULL THEN score ELSE least(1, n / 4) END, 6) AS score,
  CASE WHEN n IS NULL THEN grader ELSE 'user' END AS grader, n IS NOT NULL OR coalesce(graded, false) AS graded, sha256(CASE WHEN n IS NOT NULL AND coalesce(response_excerpt, '') = '' THEN 'graded ' || n ELSE coalesce(response_excerpt, '') END) AS hash
FROM r LEFT JOIN p USING (id)""",
    "intent_attached": f"""
WITH {_ONE_ANSWER}, {_ONE_INTENT}, p AS (SELECT max(id) AS id, intent_id FROM r GROUP BY intent_id)
SELECT r.id, sha256(CASE WHEN p.id IS NOT NULL AND i.id IS NOT NULL AND coalesce(response_excerpt, '') = '' THEN substr('see ' || intent_text, 1, 600) ELSE coalesce(response_excerpt, '') END) AS hash
FROM r LEFT JOIN p ON p.id = r.id LEFT JOIN i ON i.id = p.intent_id""",
    "intent_recall_scoped": f"""
WITH {_ONE_INTENT}, {_ONE_ANSWER}, t AS (SELECT id, project, {_KEY.format(t="intent_text")} AS k, list_distinct({oracle._intent_terms("intent_text")}) AS s FROM i),
p AS (SELECT a.id AS query_id, b.id, CASE WHEN a.k = b.k THEN 1.0 ELSE floor(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) * 1000 + 0.5) / 1000 END AS score, coalesce(a.project, '') = coalesce(b.project, '') AS own,
  a.k = b.k OR len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.45 AS near FROM t a JOIN t b ON a.id <> b.id WHERE ('0x' || right(a.id, 2))::INT % 50 = 0 AND len(a.s) > 0 AND len(b.s) > 0),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, score DESC, id) AS rank FROM p WHERE near QUALIFY rank <= 5),
b AS (SELECT intent_id, id AS best FROM r WHERE response_excerpt <> '' QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY coalesce(score, -1) DESC, id DESC) = 1)
SELECT query_id, rank, m.id, score::DOUBLE AS score, own, best FROM m LEFT JOIN b ON b.intent_id = m.id""",
    "last_messages": f"""
WITH m AS (SELECT DISTINCT lower(session_id) AS session_id, seq FROM message WHERE session_id IS NOT NULL AND seq IS NOT NULL)
SELECT session_id, seq FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 8""",
    "annotated_intents": f"""
WITH {_VERDICT}, b AS (SELECT id, list(refs.uri ORDER BY refs.uri) AS us FROM refs LEFT JOIN v ON v.uri = refs.uri WHERE kind = 'name' AND v.uri IS NULL GROUP BY id)
SELECT i.id, sha256(CASE WHEN us IS NULL THEN intent_text ELSE list_reduce(list_prepend(intent_text, us), lambda t, u: replace(t, u, u || ' [unverified]')) END) AS hash FROM i LEFT JOIN b ON b.id = i.id""",
    "intent_injections": f"""
WITH {_ONE_INTENT}, {_ONE_ANSWER}, a AS (SELECT intent_id, arg_max(response_excerpt, (coalesce(score, -1), id)) FILTER (lower(trim(outcome)) = 'resolved') AS good, arg_max(response_excerpt, (coalesce(score, -1), id)) FILTER (lower(trim(outcome)) = 'unresolved') AS bad
  FROM r WHERE response_excerpt <> '' GROUP BY 1),
l AS (SELECT i.id, 'Asked before (' || frequency || 'x): ' || {_ONELINE.format(t="intent_text", n=200)} AS h, '+ ' || {_ONELINE.format(t="good", n=240)} AS g, '- ' || {_ONELINE.format(t="bad", n=240)} AS b FROM i LEFT JOIN a ON a.intent_id = i.id),
m AS (SELECT id, b, CASE WHEN g IS NOT NULL AND length(h) + 1 + length(g) <= 400 THEN h || chr(10) || g ELSE h END AS x FROM l),
n AS (SELECT id, CASE WHEN b IS NOT NULL AND length(x) + 1 + length(b) <= 400 THEN x || chr(10) || b ELSE x END AS x FROM m)
SELECT id AS intent_id, sha256(x) AS hash, length(x) AS chars FROM n""",
    "graph_positions": "SELECT true AS xy, true AS yz, 6.0::DOUBLE AS top",
    "graph_single": f"""
WITH n AS (SELECT * FROM embeddings ORDER BY sha256(vec_id::VARCHAR), vec_id LIMIT 400),
k AS (SELECT a.vec_id AS x, b.vec_id AS y, floor({_DOT.format(a="a.embedding", b="b.embedding")} * 1e4 + 0.5) / 1e4 AS w FROM n a JOIN n b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY floor({_DOT.format(a="a.embedding", b="b.embedding")} * 1e4 + 0.5) / 1e4 DESC, b.vec_id) <= 3)
SELECT least(x, y) AS a, greatest(x, y) AS b, max(w) AS weight FROM k GROUP BY 1, 2""",
    "ingest_vectors": f"""
WITH {_STATES}, o AS ({{old}}), e AS ({{new}}) SELECT DISTINCT 'default' AS space_id, h AS content_hash, greatest(1, floor(length(text) / 4 + 0.5))::INT AS token_count, 64 AS dim, 1.0::DOUBLE AS norm
FROM (SELECT * FROM o UNION ALL SELECT * FROM e) x WHERE regexp_matches(text, '\\S')""",
    "ingest_links": f"""
WITH {_PIECES}, f AS (SELECT id, arg_min(chunk_id, ordinal) AS chunk_id FROM ch GROUP BY 1),
x AS (SELECT id, chunk_id, r.kind AS kind, r.uri AS uri, 'cites' AS relation FROM (SELECT id, chunk_id, unnest({oracle._REFS.format(t="text")}) AS r FROM ch) y
  UNION ALL SELECT f.id, f.chunk_id, 'module', unnest({files._IMPORTS}), 'imports' FROM f JOIN cur ON cur.id = f.id WHERE content IS NOT NULL)
SELECT DISTINCT id AS document_id, chunk_id, kind, uri, relation FROM x""",
    "intent_salience": f"""
WITH {_ONE_INTENT} SELECT id, round(0.5 * exp(-0.01 * ((1769904000000000 - epoch_us(last_seen)) / 86400000000)) + 0.2 * ln(1.0 + frequency), 6) AS salience, strftime(last_seen AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS seen FROM i WHERE last_seen IS NOT NULL""",
    "node_relations": f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label, round({_DOT.format(a="a.embedding", b="b.embedding")}, 6) AS x FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS rank FROM s QUALIFY rank <= 6)
SELECT query_id, id, rank, floor(x * 1e4 + 0.5) / 1e4 AS weight, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = t.label) AS siblings FROM t""",
    "attach_links": f"""
WITH n AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id::VARCHAR), vec_id) <= 40)
SELECT a.vec_id AS hit, n.vec_id AS id, floor({_DOT.format(a="a.embedding", b="n.embedding")} * 1e4 + 0.5) / 1e4 AS weight FROM embeddings a JOIN n ON a.vec_id <> n.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY floor({_DOT.format(a="a.embedding", b="n.embedding")} * 1e4 + 0.5) / 1e4 DESC, n.vec_id) <= 3""",
    "node_groups": """
WITH p AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS dim, list_max(embedding) AS top FROM embeddings)
SELECT label, dim::BIGINT AS dim, arg_max(vec_id, (top, -vec_id)) AS strongest, count(*) AS nodes FROM p GROUP BY label, dim""",
    "cluster_support": """
WITH a AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INT AS axis FROM embeddings)
SELECT label, axis, round(greatest(0.55, max(x) - avg(x)) + 0.2, 5) AS ahead, round(greatest(0.55, avg(x) - min(x)) + 0.2, 5) AS behind FROM a GROUP BY ALL""",
    "vector_functions": f"""
WITH a AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS m FROM a GROUP BY 1)
SELECT vec_id, round({_DOT.format(a="embedding", b="m")}, 5) AS ip, round(list_cosine_similarity(embedding::DOUBLE[], m), 5) AS cosine, round(list_distance(embedding::DOUBLE[], m), 5) AS l2, 1.0::DOUBLE AS unit FROM embeddings JOIN c USING (label)""",
    "text_columns": rf"""
WITH {_CUR} SELECT id, sha256(substr(trim(regexp_replace(content, '[\s\x{{0B}}]+', ' ', 'g')), 1, 200)) AS line, regexp_extract(content, '{oracle._DEF}', 2) AS symbol, greatest(1, floor(length(content) / 4 + 0.5))::BIGINT AS tokens,
  CASE WHEN length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) = 0 THEN 0 ELSE greatest(1, floor(length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) / 4 + 0.5)) END::BIGINT AS trimmed, len(regexp_extract_all(content, '(?i)the|page')) AS marks FROM cur WHERE content IS NOT NULL""",
}
_OLD_PIECES = _PIECES.replace(_CUR, "cur AS (SELECT * FROM a)")
SQL["ingest_stats"] = SQL["ingest_stats"].replace("{old}", "WITH " + _OLD_PIECES + " SELECT h FROM ch WHERE regexp_matches(text, '\\S')")
_EVERY_PIECE = _PIECES.replace(_CUR, "cur AS (SELECT * FROM e)")
SQL["ingest_references"] = SQL["ingest_references"].replace(f"WITH {_PIECES}, ", "WITH ").replace("{every}", "WITH " + _EVERY_PIECE + " SELECT * FROM ch").replace("{imports}", files._IMPORTS)
SQL["ingest_vectors"] = SQL["ingest_vectors"].replace("{old}", "WITH " + _OLD_PIECES + " SELECT * FROM ch").replace("{new}", "WITH " + _PIECES.replace(_CUR, "cur AS (SELECT * FROM b)") + " SELECT * FROM ch")
