"""p3: rebuilding conversations from message rows with keyed streaming state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch

#: Messages of a session are kept in state by blocks of so many sequence numbers, so a huge session is many keys.
BLOCK = 512
#: Rows without a sequence number go to so many keys of their own.
LOOSE = 32
#: A key's state is closed when the watermark is so far past its last event.
TIMEOUT = "1 hour"
#: How late a row may come after younger rows of an earlier micro-batch.
LATENESS = "30 days"
#: Beginnings of user text that a program wrote; fixed values of the data's definition.
MACHINE = (
    "^[\\s\\x{FEFF}]*(?:\\[SYSTEM NOTIFICATION|# AGENTS\\.md instructions|<(?:task-notification|system-reminder|local-command-stdout"
    "|command-name|command-message|recommended_plugins|environment_context|user_instructions|permissions instructions)(?![A-Za-z0-9_]))"
)
#: A character that is neither white space nor zero-width.
VISIBLE = "(?U)[^\\s\\p{Z}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]"
#: Event time of the marker that closes all open state at the end of a bounded run.
CLOSING = "9999-01-01 00:00:00"
#: Session of that marker. Its filter must stay behind the sink: before, it would keep the marker from the watermark.
MARKER = "\u0000closing"


def trimmed(text: Column | str) -> Column:
    """Text without white space at its ends (Unicode); null is taken as empty."""
    return F.coalesce(F.regexp_replace(text, "(?U)^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""), F.lit(""))


def roles(aliases: DataFrame) -> DataFrame:
    """(alias, role): spellings trimmed and case-folded, each once."""
    return aliases.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("role")).alias("resolved")).where("alias is not null").dropDuplicates(["alias"])


def marked(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Messages with session (lower case), resolved role, trimmed text and kind.

    kind: U a user row that counts, M a user row left out (blank or machine text), A an assistant row with visible
    text, a one without, T a tool row, X a row whose role can't be resolved. Rows without a session are left out.
    """
    known = roles(aliases)
    rows = messages.where("session_id is not null").withColumn("alias", F.lower(F.trim("role"))).join(F.broadcast(known), "alias", "left")
    seen = F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    kind = (
        F.when(F.col("resolved") == "tool", "T")
        .when(F.col("resolved") == "assistant", F.when(seen, "A").otherwise("a"))
        .when(F.col("resolved") == "user", F.when(seen & ~F.col("text").rlike(MACHINE), "U").otherwise("M"))
        .otherwise("X")
    )
    return rows.select(F.lower("session_id").alias("session"), "id", "seq", F.col("resolved").alias("role"), trimmed("text").alias("text"), kind.alias("kind"), "created_at")


def _reduced(s: Column) -> Column:
    """A run of kinds (U, A, a; V where a run of user rows stayed without a reply) as at most a few characters.

    The form is closed under concatenation: reducing the concatenation of reduced parts gives the reduced whole.
    """
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "U+", "U"), "a*+A[Aa]*+", "A"), "a+", "a")
    s = F.regexp_replace(s, "UaU", "UVU")
    return F.when(s.contains("V"), "V").otherwise(F.regexp_replace(s, "U.*U", "U"))


def _summary(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Merge summaries of parts, in the order of `order`, into one per `by`."""
    parts = F.sort_array(F.collect_list(F.struct(order, "shape")))
    merged = df.groupBy(*by).agg(
        F.array_join(F.transform(parts, lambda p: p["shape"]), "").alias("shape"),
        F.bool_or("broken").alias("broken"), F.bool_or("visible").alias("visible"),
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return merged.withColumn("shape", _reduced(F.col("shape")))


def _row(texts: bool) -> Column:
    """What the state holds of a message: its number, kind and role, hash and length of its text, and the text itself if asked for."""
    return F.struct("seq", "kind", "role", F.xxhash64("text").alias("h"), F.length("text").alias("len"), F.when(F.lit(texts), F.col("text")).alias("text"))


def _tables(spark: SparkSession, root: str) -> None:
    """Begin the tables of a run that has none yet, so that they can be read before anything is emitted."""
    try:
        spark.read.parquet(f"{root}/verdicts")
    except AnalysisException:
        spark.createDataFrame([], "session string, kept boolean").write.parquet(f"{root}/verdicts/batch=-1")
        rows = "array<struct<seq:int,kind:string,role:string,h:bigint,len:int,text:string>>"
        spark.createDataFrame([], f"session string, block bigint, rows {rows}, loose boolean").write.parquet(f"{root}/blocks/batch=-1")
        closing(spark).limit(0).write.parquet(f"{root}/closing")


def closing(spark: SparkSession) -> DataFrame:
    """The marker that closes all open state at the end of a bounded run; a live run has none."""
    late = spark.createDataFrame([("", MARKER, None, "", "", CLOSING)], "id string, session_id string, seq int, role string, text string, at string")
    return late.select("id", "session_id", "seq", "role", "text", F.col("at").cast("timestamp").alias("created_at"))


def emitted(batch: DataFrame, number: int, root: str) -> None:
    """Store the blocks that a micro-batch emitted, and judge the sessions they belong to by all their blocks so far.

    Each batch writes its own part, so one that is delivered again replaces what it wrote.
    """
    spark = batch.sparkSession
    batch.where(F.col("session") != MARKER).write.mode("overwrite").parquet(f"{root}/blocks/batch={number}")
    fresh = spark.read.parquet(f"{root}/blocks/batch={number}")
    if not fresh.isEmpty():
        every = spark.read.parquet(f"{root}/blocks").join(fresh.select("session").distinct(), "session", "left_semi")
        verdicts(every).write.mode("overwrite").parquet(f"{root}/verdicts/batch={number}")


def advance(spark: SparkSession, source: str, schema, aliases: DataFrame, root: str, lateness: str = LATENESS, timeout: str = TIMEOUT, texts: bool = True) -> None:
    """Take the messages that are new below `source` (a parquet path or glob) through keyed streaming state, and judge what it emits.

    The state's key is session and block of sequence numbers; it holds the distinct rows that came so far, in a session
    window over the event time, so late and repeated rows meet what is buffered. A window is emitted when the watermark
    passes its last event by `timeout`; its sessions are then judged in the same micro-batch. Rows later than `lateness`
    are dropped. State, blocks and verdicts are below `root`, where the next call goes on. Null times count as 1970.
    """
    _tables(spark, root)
    marker = closing(spark)
    rows = spark.readStream.schema(schema).parquet(source).select(*marker.columns)
    ends = spark.readStream.schema(marker.schema).parquet(f"{root}/closing")
    kinds = marked(rows.unionByName(ends), aliases).withColumn("at", F.coalesce("created_at", F.timestamp_seconds(F.lit(0))))
    loose = F.lit(-1) - F.pmod(F.xxhash64("id"), F.lit(LOOSE))
    block = F.when(F.col("seq").isNull(), loose).otherwise(F.floor(F.col("seq") / BLOCK))
    grouped = kinds.withColumn("block", block).withWatermark("at", lateness).groupBy("session", "block", F.session_window("at", timeout))
    turns = grouped.agg(F.collect_set(F.when(F.col("seq").isNotNull(), _row(texts))).alias("rows"), F.max(F.col("seq").isNull()).alias("loose"))
    flat = turns.select("session", "block", "rows", "loose")
    query = flat.writeStream.foreachBatch(lambda b, n: emitted(b, n, root)).option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def bounded(spark: SparkSession, source: str, schema, aliases: DataFrame, texts: bool) -> str:
    """Run all messages below `source` to the end and close what is open; gives the folder of blocks and verdicts.

    All files at hand are one micro-batch, in which nothing can be late; the closing marker is the next.
    """
    root = scratch(spark, "turns")
    advance(spark, source, schema, aliases, root, texts=texts)
    closing(spark).write.mode("append").parquet(f"{root}/closing")
    advance(spark, source, schema, aliases, root, texts=texts)
    return root


def judged(spark: SparkSession, root: str) -> DataFrame:
    """(session, kept): the last verdict on each session of a run."""
    return spark.read.parquet(f"{root}/verdicts").groupBy("session").agg(F.max_by("kept", "batch").alias("kept"))


def rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, turn, role, text): the turns of a run's kept sessions, from the blocks that its state emitted; turn is the sequence number."""
    blocks = spark.read.parquet(f"{root}/blocks").join(judged(spark, root).where("kept").select("session"), "session", "left_semi")
    once = blocks.select("session", F.explode("rows").alias("r")).select("session", "r.*").dropDuplicates(["session", "seq"])  # kept sessions have one row per number, but for repeats
    return once.select(F.col("session").alias("session_id"), F.col("seq").alias("turn"), "role", "text")


def verdicts(blocks: DataFrame) -> DataFrame:
    """(session, kept): the rules over the blocks that the state emitted, per session.

    Rows of equal sequence number, role and text count once. A session is kept if every sequence number from 0 to the
    highest is there once, every role is known, and of the rows without tool rows and left-out user rows one is visible
    and each run of user rows is followed by a run of assistant rows of which one is visible.
    """
    bare = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("seq", "kind", "role", "h", "len")]))
    same = blocks.groupBy("session", "block").agg(F.array_distinct(F.flatten(F.collect_list(bare))).alias("rows"), F.bool_or("loose").alias("loose"))
    rows = F.array_sort("rows")
    seqs = F.transform("rows", lambda r: r["seq"])
    kinds = F.array_join(F.transform(rows, lambda r: r["kind"]), "")
    blocks = same.select(
        "session", "block", F.floor(F.col("block") / BLOCK).alias("super"),
        _reduced(F.regexp_replace(kinds, "[TMX]", "")).alias("shape"),
        (F.col("loose") | kinds.contains("X") | (F.size(F.array_distinct(seqs)) < F.size("rows"))).alias("broken"),
        kinds.rlike("[UA]").alias("visible"),
        F.size("rows").cast("long").alias("n"), F.array_min(seqs).alias("lo"), F.array_max(seqs).alias("hi"),
    )
    sessions = _summary(_summary(blocks, ["session", "super"], "block"), ["session"], "super")
    whole = ~F.col("broken") & (F.col("lo") == 0) & (F.col("n") == F.col("hi").cast("long") + 1)
    replied = ~F.col("shape").rlike("V|Ua*$")
    return sessions.select("session", F.coalesce(whole & F.col("visible") & replied, F.lit(False)).alias("kept"))


def _run(spark: SparkSession, sf_dir: str, texts: bool) -> str:
    messages, aliases = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("message", "role_alias"))
    return bounded(spark, f"{sf_dir}/message.parquet*", messages.schema, aliases, texts)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, role, text): the turns of the kept sessions, one row each, as the state held them."""
    return rebuilt(spark, _run(spark, sf_dir, True))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id of the sessions to drop, out of all ids in chat_session and message. The state holds no texts."""
    sessions = spark.read.parquet(f"{sf_dir}/chat_session.parquet").select(F.lower("id").alias("session")).where("session is not null").distinct()
    every = sessions.join(judged(spark, _run(spark, sf_dir, False)), "session", "full_outer")
    return every.where("kept is null or not kept").select(F.col("session").alias("session_id"))
