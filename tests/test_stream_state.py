"""Streams with timers: what is emitted, and that state is dropped."""

from __future__ import annotations

import datetime as dt

from quarry.operators.logs import anchored_windows
from quarry.streaming import state as S

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp, rows, kind, slices):
    """A stream of one file a slice, each a micro-batch. rows: lists of rows for each slice."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp}/in/{i}")
    source = spark.readStream.schema(spark.createDataFrame([], kind).schema)
    return source.option("recursiveFileLookup", True).option("maxFilesPerTrigger", slices).parquet(f"{tmp}/in")


def states(spark, path, name):
    return spark.read.format("statestore").option("path", path).option("stateVarName", name).load().count()


def test_stale_threads_are_told_once_and_forgotten(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    kind = "thread string, ts timestamp"
    rows = [[("a", at(0)), ("b", at(0)), ("a", at(1))], [("b", at(9)), ("c", at(10))], [("a", at(30)), ("c", at(31))], [("d", at(60))]]
    stream = S.stale_threads(feed(spark, tmp_path, rows, kind, 1), "thread", "ts", 12 * 3_600_000)
    out = S.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.thread, r.last_us // 3_600_000_000 - int(START.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600, r.rows) for r in out.collect())
    # a goes stale twice, as it began anew; b spans two slices; d is still fresh
    assert got == [("a", 1, 2), ("a", 30, 1), ("b", 9, 2), ("c", 10, 1), ("c", 31, 1)]
    assert states(spark, f"{tmp_path}/state", "seen") == 1


def test_anchored_windows_over_slices(spark, tmp_path):
    kind = "user_id long, event_id long, ts timestamp"
    events = [(u, i * 10 + u, START + dt.timedelta(minutes=(7 if u else 1) * i)) for i in range(300) for u in range(3)]
    rows = [[e for e in events if a <= (e[2] - START).total_seconds() / 60 < b] for a, b in ((0, 100), (100, 800), (800, 10_000))]
    stream = S.anchored(feed(spark, tmp_path, rows, kind, 1), "user_id", "ts", 3600, 3)
    out = S.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    batch = anchored_windows(spark.createDataFrame(events, kind), "user_id", "ts", "event_id", seconds=3600, limit=3)
    columns = ["user_id", "event_id", "window_start", "nth", "over"]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    assert states(spark, f"{tmp_path}/state", "window") == 2  # the first user's last window ended long before the others'


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    kind = "thread long, ord long, source string"
    first, second = [(1, 0, "b"), (1, 0, "a"), (2, 0, "x"), (1, 1, "b")], [(1, 2, "c"), (1, 2, "a"), (2, 3, "y"), (2, 3, "x"), (3, 0, "z")]
    for part in (first, second):
        spark.createDataFrame(part, kind).write.mode("append").parquet(f"{tmp_path}/in")
        out = S.run_with_state(S.citation_numbers(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, out.select("thread", "source", "first", "number").collect())) == [(1, "a", 0, 1), (1, "b", 0, 2), (1, "c", 2, 3), (2, "x", 0, 1), (2, "y", 3, 2), (3, "z", 0, 1)]
