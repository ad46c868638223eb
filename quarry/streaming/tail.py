"""Streams: idempotent tail of messages into a snapshot, and event-time windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import scratch


def append_new(batch: DataFrame, out: str, keys: list[str], newest: str) -> None:
    """Append a micro-batch to the snapshot at `out`: rows whose key is not there yet, of repeated keys the one first by `newest`.

    What is stored is looked up, not kept in state, so a batch that is delivered again adds nothing.
    """
    spark = batch.sparkSession
    first = batch.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(newest), "id"))).where("__r = 1").drop("__r")
    try:
        stored = spark.read.schema(batch.schema).parquet(out).select(*keys)
        first = first.join(stored, keys, "left_anti")
    except AnalysisException:  # nothing is stored yet
        pass
    first.write.mode("append").parquet(out)


def tail_messages(spark: SparkSession, source: str, schema, out: str | None = None, state: str | None = None) -> DataFrame:
    """(session_id, seq, id, created_at): messages appended once per (session, seq), by a stream with a checkpoint.

    Rows without a session or number are skipped. A later call with the same `out` and `state` takes new files only.
    """
    out, state = out or scratch(spark, "tail"), state or scratch(spark, "tail-state")
    rows = spark.readStream.schema(schema).parquet(source).where("session_id is not null and seq is not null")
    rows = rows.select(F.lower("session_id").alias("session_id"), "seq", "id", "created_at")
    query = rows.writeStream.foreachBatch(lambda b, _: append_new(b, out, ["session_id", "seq"], "created_at")).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def windowed(spark: SparkSession, source: str, schema, lateness: str = "1 hour", out: str | None = None, state: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of the tumbling windows of a stream of events (ts, event_type, value) that the watermark has passed."""
    out, state = out or scratch(spark, "windows"), state or scratch(spark, "windows-state")
    rows = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    per = tumbling(rows)
    per.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(per.schema).parquet(out)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; works on batches, and on streams after withWatermark."""
    per = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    per = events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between them."""
    per = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return per.select("user_id", F.col("session_window.start").alias("start"), "last", "n")
