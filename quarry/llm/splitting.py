"""p1: cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.snapshot import latest

#: ChunkConfig defaults of a project.
MAX_CHARS, OVERLAP = 1500, 150
#: Offsets are summed over blocks of so many pieces, so that very long texts cost no quadratic time.
BLOCK = 256


def chunk_config(projects: DataFrame) -> DataFrame:
    """(project_id, max_chars, overlap) of each project; absent, null, non-numeric or non-positive sizes take the defaults."""
    number = lambda field: F.get_json_object("chunk_cfg", f"$.{field}").try_cast("int")
    size, lap = number("max_chars"), number("overlap")
    return projects.select(
        F.col("id").alias("project_id"),
        F.when(size > 0, size).otherwise(MAX_CHARS).alias("max_chars"),
        F.when(lap >= 0, lap).otherwise(OVERLAP).alias("overlap"),
    ).dropDuplicates(["project_id"])


def _pattern(limit: Column, step: Column) -> Column:
    """Alternatives by strength of the boundary. Each is one bounded quantifier with a zero-width test of its end:
    the rest of the text, paragraph, line, sentence, white space within the step, the same within the limit, an
    ideographic full stop, and plain characters (not before a combining mark if that can be helped)."""
    least = F.ceil(step / 3).cast("int")
    parts = [
        ".{1,", step, "}\\z|.{", least, ",", step, "}(?<=\\n)(?<=\\n[ \\t\\r]{0,200}\\n)|.{", least, ",", step, "}(?<=\\n|\\r(?!\\n))|.{",
        least, ",", step, "}(?<=[.!?…][\"'”’»)\\]]{0,3}[ \\t])|.{1,", step, "}(?<=[ \\t\\n]|\\r(?!\\n))|.{1,", step,
        "}(?=[ \\t\\r\\n])|.{1,", limit, "}(?<=[ \\t\\n]|\\r(?!\\n))|.{1,", limit, "}(?=[ \\t\\r\\n]|\\z)|.{", least, ",", step, "}(?<=[。！？])|.{1,", step, "}(?!\\p{M})|.{1,", step, "}",
    ]
    return F.concat(F.lit("(?s)"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _starts(sizes: Column) -> Column:
    """Running sums before each element, in two levels: sums of blocks, then inside each block."""
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    zero = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    running = lambda xs, at: F.aggregate(xs, zero(at), add, lambda acc: acc["all"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK)), lambda b: F.slice(sizes, (b * BLOCK + 1).cast("int"), BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), running(sums, F.lit(0)).alias("s")), lambda z: running(z["b"], z["s"])))


def split_oversized(texts: DataFrame, content: str = "content", max_chars: str = "max_chars", overlap: str = "overlap") -> DataFrame:
    """Pieces of the rows whose `content` is longer than `max_chars` code points.

    Adds piece_no, start (offset of the part that is new), overlap_chars, boundary and piece; other columns of the
    input stay, except those names. A piece is at most max_chars long; without their overlaps the pieces joined give
    the content. boundary says where the new part ends: end, paragraph, line, sentence, space, stop (an
    ideographic full stop) or forced. The last two occur just where more than max_chars characters without space,
    tab, CR or LF follow each other.
    overlap is taken as at most half of max_chars and starts at a word; a piece that fills the limit has less of it.
    Null, empty and short texts give no rows. Repeated input rows give repeated pieces. A non-positive or null
    max_chars or a null overlap takes the defaults.
    """
    own = ["piece_no", "start", "overlap_chars", "boundary", "piece"]
    kept = [F.col(f"`{c}`") for c in texts.columns if c not in own]
    limit = F.when(F.col(max_chars) > 0, F.col(max_chars)).otherwise(MAX_CHARS).cast("int")
    lap = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(OVERLAP)), F.lit(0)), F.floor(limit / 2)).cast("int")
    cut = (
        texts.select(*kept, limit.alias("__limit"), lap.alias("__lap"))
        .where(F.length(content) > F.col("__limit"))
        .withColumn("__parts", F.regexp_extract_all(F.col(content), _pattern(F.col("__limit"), F.col("__limit") - F.col("__lap")), F.lit(0)))
        .withColumn("__starts", _starts(F.transform("__parts", lambda p: F.length(p).cast("long"))))
    )
    # each part with the two before it, for the look back, and the first character after it
    at = lambda i: F.coalesce(F.get(F.col("__parts"), i), F.lit(""))
    rows = cut.withColumn(
        "__row",
        F.explode(
            F.transform(
                F.col("__parts"),
                lambda p, i: F.struct(
                    i.alias("i"), F.get(F.col("__starts"), i).alias("start"), p.alias("p"), F.concat(at(i - 2), at(i - 1)).alias("before"), F.substring(at(i + 1), 1, 1).alias("after")
                ),
            )
        ),
    )
    part, after = F.col("__row.p"), F.col("__row.after")
    room = F.least(F.col("__lap"), F.col("__limit") - F.length(part))
    back = F.when(room > 0, F.right(F.col("__row.before"), room)).otherwise("")
    words = F.regexp_replace(back, "^[^ \\t\\r\\n]*[ \\t\\r\\n]+", "")
    boundary = (
        F.when(after == "", "end")
        .when(part.rlike("\\n[ \\t\\r]*\\n\\z"), "paragraph")
        .when(part.rlike("[\\n\\r]\\z"), "line")
        .when(part.rlike("(?:[.!?…][\"'”’»)\\]]{0,3}[ \\t])\\z"), "sentence")
        .when(part.rlike("[ \\t]\\z") | after.rlike("[ \\t\\r\\n]"), "space")
        .when(part.rlike("[。！？]\\z"), "stop")
        .otherwise("forced")
    )
    out = rows.withColumn("__back", F.when(words == "", back).otherwise(words))
    return out.select(
        *kept,
        F.col("__row.i").alias("piece_no"),
        F.col("__row.start").alias("start"),
        F.length("__back").alias("overlap_chars"),
        boundary.alias("boundary"),
        F.concat(F.col("__back"), part).alias("piece"),
    )


def current_documents(documents: DataFrame) -> DataFrame:
    """The current row of each (project_id, source_id, rel_path): greatest created_at, then greatest content hash and id."""
    return latest(documents, ["project_id", "source_id", "rel_path"], "created_at", [F.xxhash64("content"), "id"])


def pieces(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """split_oversized over the current documents, each with its project's sizes; unknown projects take the defaults."""
    now = current_documents(documents).select(F.col("id").alias("document_id"), "project_id", "content")
    sized = now.join(chunk_config(projects), "project_id", "left")
    return split_oversized(sized).select("document_id", "piece_no", "start", "overlap_chars", "boundary", "piece")


def found(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """(document_id, cut): forced if a piece of the document ends inside a run without white space, else natural."""
    forced = F.bool_or(F.col("boundary").isin("forced", "stop"))
    return pieces(documents, projects).groupBy("document_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))
