"""Ingest as one plan: changed files to chunks, vectors and references, merged into the next snapshot of a store."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.chunking import chunk_files
from quarry.operators.snapshot import latest

KEY = ["project_id", "source_id", "rel_path"]
SPACE = "default"


class Store(NamedTuple):
    """documents: id, KEY, title, url, content_hash, mtime, created_at, updated_at; chunks: chunk_id, document_id, project_id,
    ordinal, title, text, content_hash, unit_type, tokens; vectors: space_id, content_hash, token_count, embedding;
    references: kind, uri, first_seen, last_seen; links: chunk_id, kind, uri, relation."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    references: DataFrame
    links: DataFrame


def content_hash(content: Column) -> Column:
    """Of the text after NUL characters are taken out; null counts as empty."""
    return F.sha2(F.replace(F.coalesce(content, F.lit("")), F.lit("\0"), F.lit("")), 256)


def changed(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Files (KEY, content, ...) that the stored documents lack or have with another hash, with `state` new or changed and the id they keep."""
    new = files.withColumn("content_hash", content_hash(F.col("content")))
    old = stored.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("id").alias("__id"), F.col("content_hash").alias("__hash"))
    on = [new[k].eqNullSafe(old[f"__{k}"]) for k in KEY]
    both = new.join(old, on[0] & on[1] & on[2], "left").where(F.col("__id").isNull() | (F.col("__hash") != F.col("content_hash")))
    state = F.when(F.col("__id").isNull(), "new").otherwise("changed")
    return both.withColumns({"state": state, "id": F.coalesce("__id", "id")}).select(*new.columns, "state")


def merge_documents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored documents with title, url, hash and mtime of the changed ones; ids and times of creation stay. New ones are added."""
    cells = ["title", "url", "content_hash", "mtime"]
    new = fresh.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("id").alias("__id"), F.col("created_at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in cells])
    on = [stored[k].eqNullSafe(new[f"__{k}"]) for k in KEY]
    both = stored.join(new, on[0] & on[1] & on[2], "full_outer")
    there, came = F.col("id").isNotNull(), F.col("__id").isNotNull()
    take = lambda c: F.when(came, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        F.coalesce("id", "__id").alias("id"), *[F.when(there, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in KEY], *[take(c) for c in cells],
        F.coalesce("created_at", "__at").alias("created_at"), F.coalesce("__at", "updated_at").alias("updated_at"),
    )


def chunks_of(files: DataFrame, chunker: Callable[[DataFrame], DataFrame] = chunk_files) -> DataFrame:
    """Rows of Store.chunks for files (id, project_id, rel_path, content, ...). An id is a hash of document, ordinal and text."""
    cut = chunker(files).join(files.select("id", "project_id"), "id")
    digest = F.sha2("text", 256)
    key = F.sha2(F.concat_ws("/", "id", F.col("ordinal").cast("string"), digest), 256)
    return cut.select(
        F.substring(key, 1, 32).alias("chunk_id"), F.col("id").alias("document_id"), "project_id", F.col("ordinal").cast("int").alias("ordinal"), "title", "text",
        digest.alias("content_hash"), "unit_type", T.token_estimate(F.col("text")).alias("tokens"),
    )


def replace_chunks(stored: DataFrame, fresh: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of the documents (id) replaced by the fresh ones, those of others kept."""
    return stored.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").unionByName(fresh)


def missing_vectors(stored: DataFrame, chunks: DataFrame, space: str = SPACE) -> DataFrame:
    """(content_hash, text, tokens): the texts of chunks that the space has no vector of; blank ones need none."""
    texts = chunks.where(F.col("text").rlike("\\S")).groupBy("content_hash").agg(F.min("text").alias("text"), F.max("tokens").alias("tokens"))
    return texts.join(stored.where(F.col("space_id") == space).select("content_hash"), "content_hash", "left_anti")


def merge_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per (space_id, content_hash). Where one is stored it stays, and takes the new row's token_count only."""
    key = ["space_id", "content_hash"]
    fresh = new.groupBy(*key).agg(F.max_by(F.struct("token_count", "embedding"), F.struct(F.coalesce("token_count", F.lit(-1)), F.hash("embedding"))).alias("n"))
    there = F.col("__there").isNotNull()
    both = stored.withColumn("__there", F.lit(True)).join(fresh, key, "full_outer")
    count = F.when(F.col("n").isNotNull(), F.coalesce("n.token_count", "token_count")).otherwise(F.col("token_count"))
    return both.select(*key, count.alias("token_count"), F.when(there, F.col("embedding")).otherwise(F.col("n.embedding")).alias("embedding"))


def references_of(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references (kind, uri, at), links): what chunks cite, and the modules that files import, linked from their first chunk."""
    cited = chunks.select("chunk_id", "document_id", F.explode(T.references(F.col("text"))).alias("r")).select("chunk_id", "document_id", "r.kind", "r.uri", F.lit("cites").alias("relation"))
    first = chunks.groupBy("document_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))
    modules = files.select(F.col("id").alias("document_id"), F.explode(T.imports(F.col("content"), F.col("rel_path"))).alias("uri"))
    imported = modules.join(first, "document_id").select("chunk_id", "document_id", F.lit("module").alias("kind"), "uri", F.lit("imports").alias("relation"))
    links = cited.unionByName(imported)
    dated = links.join(files.select(F.col("id").alias("document_id"), F.col("created_at").alias("at")), "document_id").select("kind", "uri", "at")
    return dated, links.select("chunk_id", "kind", "uri", "relation").distinct()


def merge_references(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per (kind, uri) with the first and the last time it was seen."""
    rows = stored.unionByName(seen.select("kind", "uri", F.col("at").alias("first_seen"), F.col("at").alias("last_seen")))
    return rows.groupBy("kind", "uri").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def ingest(store: Store, files: DataFrame, embed: Callable[[Column], Column], chunker: Callable[[DataFrame], DataFrame] = chunk_files, space: str = SPACE) -> tuple[Store, DataFrame]:
    """(next store, stats (files, changed, chunks, embedded)) after the files (id, KEY, title, url, content, mtime, created_at).

    Only files whose hash differs are cut; only texts without a vector are embedded. `embed` makes a vector of a text column:
    an expression, or a pandas UDF around a model. Repeated keys count once, the latest. Files without chunks are stored too.
    """
    now = latest(files, KEY, "created_at", [F.xxhash64("content"), "id"])
    fresh = changed(store.documents, now)
    cut = chunks_of(fresh, chunker)
    lacking = missing_vectors(store.vectors, cut, space)
    vectors = lacking.select(F.lit(space).alias("space_id"), "content_hash", F.col("tokens").cast("int").alias("token_count"), embed(F.col("text")).alias("embedding"))
    seen, links = references_of(fresh, cut)
    kept = store.links.join(cut_ids(store.chunks, fresh), "chunk_id", "left_anti")
    following = Store(
        merge_documents(store.documents, fresh), replace_chunks(store.chunks, cut, fresh), merge_vectors(store.vectors, vectors),
        merge_references(store.references, seen), kept.unionByName(links),
    )
    count = lambda df, c: df.agg(F.count("*").alias(c))
    one = count(now, "files").withColumn("k", F.lit(1))
    for df, c in ((fresh, "changed"), (cut, "chunks"), (lacking, "embedded")):
        one = one.join(count(df, c).withColumn("k", F.lit(1)), "k")
    return following, one.drop("k")


def cut_ids(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that belong to the documents (id)."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("chunk_id")


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(document_id, chunks, fingerprint): a hash of the sorted hashes of each document's chunks."""
    hashes = F.array_join(F.array_sort(F.collect_list("content_hash")), "")
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sha2(hashes, 256).alias("fingerprint"))


def empty_store(files: DataFrame, dim_type: str = "array<double>") -> Store:
    """A store without rows, for files of the types at hand."""
    spark = files.sparkSession
    kind = lambda c: files.schema[c].dataType.simpleString()
    made = lambda schema: spark.createDataFrame([], schema)
    return Store(
        made(", ".join(f"{c} {kind(c)}" for c in ["id", *KEY, "title", "url"]) + f", content_hash string, mtime {kind('mtime')}, created_at timestamp, updated_at timestamp"),
        made(f"chunk_id string, document_id {kind('id')}, project_id {kind('project_id')}, ordinal int, title string, text string, content_hash string, unit_type string, tokens bigint"),
        made(f"space_id string, content_hash string, token_count int, embedding {dim_type}"),
        made("kind string, uri string, first_seen timestamp, last_seen timestamp"),
        made("chunk_id string, kind string, uri string, relation string"),
    )
