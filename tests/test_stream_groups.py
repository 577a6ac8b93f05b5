"""Keys of streams with timers share state rows: as many as there are groups, with the results of each key on its own."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from test_stream_state import START, feed, states

from quarry.streaming import state as S


def micros(ts):
    return int(ts.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


@pytest.fixture
def parts():
    """Rows of 90 threads in three parts of 100 hours, in order of time; one thread has no name."""
    rng = random.Random(5)
    rows = [(None if k == 0 else k, START + dt.timedelta(seconds=rng.randrange(1_080_000))) for k in range(90) for _ in range(rng.randrange(1, 40))]
    rows = [(k, i, at) for i, (k, at) in enumerate(rows)]
    return [[r for r in rows if i * 360_000 <= (r[2] - START).total_seconds() < (i + 1) * 360_000] for i in range(3)]


def test_threads_of_a_group_share_a_state(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(S, "GROUPS", 4)
    gap = 20 * 3600
    stream = S.stale_threads(feed(spark, tmp_path, parts, "thread long, event_id long, ts timestamp", 1), "thread", "ts", gap * 1000)
    out = S.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    rows = sorted((r for part in parts for r in part), key=lambda r: r[2])
    clock = rows[-1][2] - dt.timedelta(minutes=10)
    expected, open_ = [], {}
    for k, _, at in rows:
        if k in open_ and (at - open_[k][0]).total_seconds() >= gap:
            expected.append((k, micros(open_[k][0]), open_[k][1]))
            del open_[k]
        open_[k] = (at, open_.get(k, (at, 0))[1] + 1)
    expected += [(k, micros(at), n) for k, (at, n) in open_.items() if at + dt.timedelta(seconds=gap) <= clock]
    assert sorted(map(str, map(tuple, out.select("thread", "last_us", "rows").collect()))) == sorted(map(str, expected))
    assert states(spark, f"{tmp_path}/state", "seen") <= 4


def test_windows_of_a_group_share_a_state(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(S, "GROUPS", 4)
    stream = S.anchored(feed(spark, tmp_path, parts, "user_id long, event_id long, ts timestamp", 1), "user_id", "ts", 36_000, 3)
    out = S.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    expected, open_ = [], {}
    for k, i, at in sorted((r for part in parts for r in part), key=lambda r: (r[2], r[1])):
        start, n = open_.get(k, (None, 0))
        if start is None or (at - start).total_seconds() >= 36_000:
            start, n = at, 0
        open_[k] = (start, n + 1)
        expected.append((k, i, micros(start), n + 1, n + 1 > 3))
    assert sorted(map(str, map(tuple, out.select("user_id", "event_id", "window_start", "nth", "over").collect()))) == sorted(map(str, expected))
    assert states(spark, f"{tmp_path}/state", "window") <= 4


def test_numbers_of_a_group_share_a_state(spark, tmp_path, monkeypatch):
    """Threads with and without a name, rows without ord or source, and more micro-batches than a list has parts."""
    monkeypatch.setattr(S, "GROUPS", 4)
    monkeypatch.setattr(S, "PARTS", 2)
    rng = random.Random(7)
    uses = [(rng.choice([None, *range(40)]), at, rng.choice([None, *(f"source{i}" for i in range(25))])) for at in range(1200)]
    uses = [(None if k is None else k * 10**9, at // 3, s) for k, at, s in uses] + [(5, None, "unplaced"), (5, None, "source1"), (6, None, "unplaced")]
    rows = [[u for u in uses if (9 if u[1] is None else u[1] // 40) == i] for i in range(10)]
    stream = S.citation_numbers(feed(spark, tmp_path, rows, "thread long, ord long, source string", 1))
    out = S.run_with_state(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    first, expected = {}, []
    for k, at, source in uses:
        if source is not None:
            at = float("inf") if at is None else at
            first[k, source] = min(at, first.get((k, source), at))
    for k in {k for k, _ in first}:
        mine = sorted((at, source) for (name, source), at in first.items() if name == k)
        expected += [(k, source, None if at == float("inf") else at, n) for n, (at, source) in enumerate(mine, 1)]
    assert sorted(map(str, map(tuple, out.select("thread", "source", "first", "number").collect()))) == sorted(map(str, expected))
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "known").option("flattenCollectionTypes", True).load()
    assert 1 <= held.select("key").distinct().count() <= 4
    assert held.count() <= 4 * 3


def test_turns_without_number_are_numbered_last(spark, tmp_path):
    from conftest import same_rows
    import duckdb

    from quarry.plans.registry import ORACLE_SQL, QUERIES

    rows = [(1, 0, "user", "wonderful"), (1, 4, "user", "excellent"), (1, None, "user", "something wonderful")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(QUERIES["r20_citation_stream"](spark, str(tmp_path)), con.sql(ORACLE_SQL["r20_citation_stream"]))
