"""Structured Streaming twins of the sync and log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def envelope(raw: DataFrame) -> DataFrame:
    """Events from JSON text: the token may stand in one of three places; events without id or token are dropped."""
    schema = "event_id string, event_type string, ts string, token string, file struct<token:string>, object struct<file_token:string>"
    e = raw.select(F.from_json("value", schema).alias("e"))
    token = F.coalesce("e.token", "e.file.token", "e.object.file_token")
    out = e.select("e.event_id", "e.event_type", F.to_timestamp("e.ts").alias("ts"), token.alias("token"))
    return out.where("event_id is not null and event_id <> '' and token is not null and token <> ''")


def once(events: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Each event once within the watermark. A sink that must never see one twice also anti-joins what it holds."""
    return events.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def route(event_type: str = "event_type"):
    return F.when(F.col(event_type) == "error", "delete").when(F.col(event_type).isin("purchase", "signup"), "change").otherwise("other")


def debounced(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """One job for each key and bucket of event time, due when the bucket has ended."""
    bucket = F.window(ts, f"{seconds} seconds")
    return events.groupBy(key, bucket).agg(F.count("*").alias("n")).select(key, F.col("window.end").alias("due"), "n")


def metrics(events: DataFrame, ts: str, kind: str, value: str, every: str) -> DataFrame:
    """Requests, errors and mean value for each kind and tumbling window."""
    w = F.window(ts, every)
    errors = F.sum(F.when(F.col(kind) == "error", 1).otherwise(0))
    out = events.withWatermark(ts, LATE).groupBy(w, kind).agg(F.count("*").alias("requests"), errors.alias("errors"), F.sum(value).alias("total"))
    return out.select(F.unix_micros("window.start").alias("start_us"), kind, "requests", "errors", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Sessions that end after a gap without events."""
    out = events.withWatermark(ts, LATE).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into Parquet, and reads the result."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def apply_batches(stream: DataFrame, apply, checkpoint: str) -> None:
    """foreachBatch over what there is now. apply(df, batch_id) must be idempotent for a batch_id."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
