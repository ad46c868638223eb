"""Grounding of references: verbatim containment in texts, groundedness of lists of references, marks behind unverified ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import annotate

#: A text and a reference are runs of letters, runs of digits, and single other characters; blanks stand between.
RUN = "[\\p{L}\\p{M}]+|\\p{N}+|\\S"
#: Characters of a reference's first run, from its end, that an edge is found by.
EDGE = 3


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))


def _edge(runs: Column) -> Column:
    """Key of the first two runs: the end of the first, up to EDGE characters, and the second's first character."""
    return F.concat(F.lit("e"), F.right(F.get(runs, F.lit(0)), F.lit(EDGE)), F.lit(" "), F.substring(F.get(runs, F.lit(1)), 1, 1))


def _inside_words(single: DataFrame, cut: DataFrame) -> DataFrame:
    """(uri, text_id) of references of one run (uri, w) and texts (text_id, r) whose words may have them: by the rarest of their three characters."""
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
    asked = single.select("uri", F.explode(F.array_distinct(grams(F.col("w"), F.least(F.length("w"), F.lit(3))))).alias("g"))
    words = cut.select("text_id", F.explode(F.array_distinct("r")).alias("w"))
    pieces = words.select("text_id", F.explode(F.array_distinct(F.concat(*[grams(F.col("w"), F.lit(n)) for n in (1, 2, 3)]))).alias("g"))
    near = pieces.join(asked.select("g").distinct(), "g", "left_semi").distinct()
    most = asked.join(near.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("uri").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    return most.join(near, "g").select("uri", "text_id")


def contained(references: DataFrame, texts: DataFrame) -> DataFrame:
    """(uri, text_id): the smallest id of (id, text) whose text has the uri, whatever the case; for each uri of (uri) that is in a text.

    No pair is compared that shares no key. A reference's inner runs stand as whole runs in any text that has it, its first
    two runs as an edge; of those keys the one of the fewest texts is looked up, and only texts that have it are searched.
    A reference of one run is looked up by the ends of its characters' pairs: letters of a longer word hide it from runs.
    Null and blank references and null texts give no rows; repeated ones count once.
    """
    uris = references.where("uri is not null and trim(uri) <> ''").select("uri").distinct()
    runs = _runs(F.col("uri"))
    keyed = uris.select("uri", F.explode(F.array(runs)).alias("r"))
    inner = F.transform(F.slice("r", 2, F.greatest(F.size("r") - 2, F.lit(0))), lambda x: F.concat(F.lit("r"), x))
    keys = F.when(F.size("r") > 1, F.array_distinct(F.concat(inner, F.array(_edge(F.col("r"))))))
    many = keyed.where(F.size("r") > 1).select("uri", F.explode(keys).alias("key"))
    wanted = many.select("key").distinct()
    rows = texts.where("text is not null").select(F.col("id").alias("text_id"), "text")
    cut = rows.select("text_id", F.explode(F.array(_runs(F.col("text")))).alias("r"))
    two = cut.select("text_id", F.explode(F.arrays_zip(F.col("r").alias("a"), F.slice("r", 2, F.size("r")).alias("b"))).alias("x")).select("text_id", "x.a", "x.b")
    edge = lambda n: F.when((F.length("a") >= n) & F.col("b").isNotNull(), F.concat(F.lit("e"), F.right("a", F.lit(n)), F.lit(" "), F.substring("b", 1, 1)))
    own = two.select("text_id", F.explode(F.array(F.concat(F.lit("r"), "a"), *[edge(n) for n in range(1, EDGE + 1)])).alias("key"))
    postings = own.join(wanted, "key", "left_semi").distinct()
    counts = postings.groupBy("key").agg(F.count("*").alias("n"))
    rarest = many.join(counts, "key").groupBy("uri").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.count("*").alias("found"))
    whole = rarest.join(many.groupBy("uri").agg(F.count("*").alias("keys")), "uri").where("found = keys").select("uri", "key")
    pairs = whole.join(postings, "key").select("uri", "text_id")
    single = keyed.where(F.size("r") == 1).select("uri", F.get("r", F.lit(0)).alias("w"))
    if not single.isEmpty():
        pairs = pairs.unionByName(_inside_words(single, cut))
    low = rows.select("text_id", F.explode(F.array(F.lower("text"))).alias("low"))  # once a text, not once a pair
    held = pairs.join(low, "text_id").where(F.contains("low", F.lower("uri")))
    return held.groupBy("uri").agg(F.min("text_id").alias("text_id"))


def verdicts(cited: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, uri, verified, text_id) of the distinct references (kind, uri): verified if some text has it verbatim."""
    known = cited.where("uri is not null and trim(uri) <> ''").select("kind", "uri").distinct()
    return known.join(contained(cited, texts), "uri", "left").select("kind", "uri", F.col("text_id").isNotNull().alias("verified"), "text_id")


def groundedness(cited: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, verified, unverified, grounded) of lists of references (id, kind, uri): how many of its distinct ones the texts have."""
    own = cited.where("uri is not null and trim(uri) <> ''").select("id", "kind", "uri").distinct()
    told = own.join(verdicts(cited, texts), ["kind", "uri"])
    per = told.groupBy("id").agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))
    return per.withColumn("grounded", F.col("unverified") == 0)


def marked(answers: DataFrame, cited: DataFrame, texts: DataFrame, mark: str = " [unverified]") -> DataFrame:
    """(id, text) of answers (id, text): each unverified reference of (id, kind, uri) with the mark behind it."""
    bad = cited.select("id", "kind", "uri").distinct().join(verdicts(cited, texts).where("not verified"), ["kind", "uri"])
    per = bad.groupBy("id").agg(F.array_sort(F.collect_set("uri")).alias("uris"))
    return answers.join(per, "id", "left").select("id", annotate(F.col("text"), F.col("uris"), mark).alias("text"))
