"""Stream queries over `events`: each one runs until all files are read and equals its batch twin.

The table's file is read as a stream of its folder; windows that the watermark has not closed are flushed by a late marker.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import sync as Y
from quarry.plans.analytics import ANCHORED_SQL
from quarry.plans.base import Tables, query
from quarry.plans.scans import scratch
from quarry.sources.shared import stored
from quarry.streaming import events as T
from quarry.streaming import state as S
from quarry.streaming.changes import Changes

#: Later than all events, so that the watermark passes every window; dropped from results.
MARKER = "2100-01-01 00:00:00"


def stream(t: Tables, *, twice: bool = False) -> DataFrame:
    """The events as a stream of files, in event order, and a marker row at the end."""
    path = scratch(t, "events")
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    if twice:
        rows = rows.unionByName(rows)
    rows.write.parquet(f"{path}/a")
    marker = t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(MARKER).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("marker").alias("event_type"), F.lit(0.0).alias("value"))
    marker.write.parquet(f"{path}/b")
    source = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("latestFirst", False)
    return source.parquet(path)


def done(t: Tables, df: DataFrame, name: str) -> DataFrame:
    return T.run_to_table(df, scratch(t, name), scratch(t, name + "-state"))


@query("t1_envelope", "SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS token FROM events WHERE event_type <> 'signup'")
def t1(t: Tables) -> DataFrame:
    """Events as JSON lines, the token in one of three places; signups have none and drop out."""
    path = scratch(t, "raw")
    user = F.col("user_id").cast("string")
    file = F.when(F.col("event_type") == "view", F.struct(user.alias("token")))
    inner = F.when(F.col("event_type") == "click", F.struct(user.alias("file_token")))
    plain = F.when(F.col("event_type").isin("purchase", "error"), user)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("ts").cast("string").alias("ts"), plain.alias("token"), file.alias("file"), inner.alias("object")))
    t.events.select(line.alias("value")).write.text(path)
    raw = t.spark.readStream.schema("value string").text(path)
    return done(t, T.envelope(raw), "t1").select("event_id", "event_type", "token")


@query("t2_dedup_events", "SELECT event_id, event_type FROM events")
def t2(t: Tables) -> DataFrame:
    """Every event arrives twice and is kept once."""
    return done(t, T.once(stream(t, twice=True)).select("event_id", "event_type"), "t2").where("event_id >= 0")


@query("t3_route", "SELECT CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('purchase', 'signup') THEN 'change' ELSE 'other' END AS route, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def t3(t: Tables) -> DataFrame:
    routed = done(t, stream(t).where("event_id >= 0").select(T.route().alias("route")), "t3")
    return routed.groupBy("route").agg(F.count("*").alias("n"))


@query("t4_debounce", "SELECT user_id, epoch_us(time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND) AS due_us, count(*)::BIGINT AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL")
def t4(t: Tables) -> DataFrame:
    changes = stream(t).withWatermark("ts", T.LATE).where("event_type in ('purchase', 'signup', 'marker')")
    jobs = T.debounced(changes, "user_id", "ts", 60).select("user_id", F.unix_micros("due").alias("due_us"), "n")
    return done(t, jobs, "t4").where("user_id >= 0")


@query(
    "t5_apply_to_ledger",
    """WITH e AS (SELECT user_id, min((ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) AS f, max((ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) AS l, max((ts, event_id)) FILTER (event_type = 'error') AS g FROM events GROUP BY user_id),
j AS (SELECT coalesce(user_id, doc_id) AS user_id, l, g, doc_id IS NOT NULL AS known, g IS NOT NULL AND (doc_id IS NOT NULL OR coalesce(f < g, false)) AS deletes FROM documents FULL JOIN e ON user_id = doc_id)
SELECT 'ledger' AS part, user_id, CASE WHEN deletes AND (l IS NULL OR g > l) THEN 'soft_deleted' ELSE 'active' END AS status, NULL AS job_type FROM j WHERE known OR l IS NOT NULL
UNION ALL SELECT 'job', user_id, 'pending', 'mark_missing' FROM j WHERE deletes UNION ALL SELECT 'job', user_id, 'pending', 'upsert' FROM j WHERE l IS NOT NULL""",
)
def t5(t: Tables) -> DataFrame:
    """The documents are the ledger; purchases and signups of a user change the row of that id, errors delete it. Three micro-batches
    leave their changes, and the jobs they ask for."""
    ledger = Changes(t.spark, scratch(t, "ledger"), ["user_id"], "user_id long, status string")
    jobs = Changes(t.spark, scratch(t, "jobs"), ["user_id", "job_type"], "user_id long, job_type string, status string, attempts int")
    ledger.write(0, t.documents.select(F.col("doc_id").alias("user_id"), F.lit("active").alias("status")))

    def apply(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1  # the ledger as it stands is batch 0
        named = batch.select("user_id").distinct()
        changed = stored(Y.apply_events(ledger.read(number).join(named, "user_id", "left_semi"), batch, "user_id", T.route()), "t5-batch")
        asked = changed.select("user_id", F.explode("jobs").alias("job_type"))
        old = jobs.read(number).join(asked, ["user_id", "job_type"], "left_semi")
        jobs.write(number, Y.enqueue(old, asked, ["user_id", "job_type"], revive=True))
        ledger.write(number, changed.select("user_id", "status"))

    state = scratch(t, "t5-state")
    for arrived in in_order(t, "t5-events", timed(t, "event_type")):
        T.apply_batches(arrived, apply, state)
    rows = ledger.read().select(F.lit("ledger").alias("part"), "user_id", "status")
    return rows.unionByName(jobs.read().select(F.lit("job").alias("part"), "user_id", "status", "job_type"), allowMissingColumns=True)


@query("t6_reconcile", "SELECT user_id, max(event_id) AS last_event, count(*)::BIGINT AS n, 2 AS passes FROM events GROUP BY user_id")
def t6(t: Tables) -> DataFrame:
    """Two scheduled passes: each takes what has arrived since the one before and merges it into the totals so far."""
    from quarry.operators.sync import VersionedTable

    inbox, state, totals = scratch(t, "t6-inbox"), scratch(t, "t6-state"), VersionedTable(t.spark, scratch(t, "t6-totals"))
    arrived = t.events.select("user_id", "event_id", (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        arrived.where(F.col("half") == half).drop("half").write.mode("append").parquet(inbox)
        source = t.spark.readStream.schema("user_id long, event_id long").parquet(inbox)

        def merge(batch: DataFrame, batch_id: int) -> None:
            new = batch.groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))
            old = totals.read() if totals.version() else new.limit(0).withColumn("passes", F.lit(0))
            if totals.version() is not None and totals.version() > batch_id:
                return  # a batch that comes again is merged already
            both = old.unionByName(new.withColumn("passes", F.lit(0)))
            totals.commit(both.groupBy("user_id").agg(F.max("last_event").alias("last_event"), F.sum("n").alias("n"), F.lit(batch_id + 1).alias("passes")))

        T.apply_batches(source, merge, state)
    return totals.read()


def in_order(t: Tables, name: str, rows: DataFrame) -> Iterator[DataFrame]:
    """Rows that come in three parts, one after the other in time: the stream of what has come so far, after each part. A run takes up
    what is new as one micro-batch, of as many files as the part has tasks."""
    path = scratch(t, name)
    for i, days in enumerate(("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20")):
        rows.where(days).write.parquet(f"{path}/{i}")
        yield t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(path)


def timed(t: Tables, *more: str) -> DataFrame:
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", *more)


@query("t7_anchored_windows", ANCHORED_SQL)
def t7(t: Tables) -> DataFrame:
    """The batch twin's windows; what the watermark has passed is no longer in the state."""
    out, state = scratch(t, "t7"), scratch(t, "t7-state")
    for arrived in in_order(t, "t7-events", timed(t)):
        rows = S.run_with_state(S.anchored(arrived, "user_id", "ts", 3600, 3), out, state)
    return rows


@query(
    "t8_rolling_metrics",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*)::BIGINT AS requests, count(*) FILTER (event_type = 'error')::BIGINT AS errors, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
)
def t8(t: Tables) -> DataFrame:
    out = done(t, T.metrics(stream(t), "ts", "event_type", "value", "1 hour"), "t8").where("event_type <> 'marker'")
    return out.select("start_us", "event_type", "requests", "errors", F.round(F.col("total") / F.col("requests"), 6).alias("mean"))


@query(
    "t9_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, no""",
)
def t9(t: Tables) -> DataFrame:
    return done(t, T.sessions(stream(t), "ts", "user_id", "30 minutes"), "t9").where("user_id >= 0")


@query(
    "t9_stale_threads",
    """WITH h AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS thread, max(ts) AS last, count(*)::BIGINT AS rows FROM events GROUP BY ALL)
SELECT thread, epoch_us(last) AS last_us, rows FROM h WHERE epoch_us(last) + 3 * 86400000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)""",
)
def t9_stale(t: Tables) -> DataFrame:
    """Threads (a user's day) of which nothing has come for three days, by the clock of the events, which lags ten minutes."""
    thread = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    out, state = scratch(t, "t9-stale"), scratch(t, "t9-stale-state")
    for arrived in in_order(t, "t9-events", timed(t)):
        rows = S.run_with_state(S.stale_threads(arrived.select("ts", thread.alias("thread")), "thread", "ts", 3 * 86_400_000), out, state)
    return rows
