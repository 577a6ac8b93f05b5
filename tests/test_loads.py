"""Nested content against a recursive version, loads that fail a gate, deletes and repairs, and changes that come again."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import gates, nested
from quarry.operators import sync as Y
from quarry.sources.shared import new_path
from quarry.streaming.changes import Changes
from quarry.streaming.events import route


def flat(content, inside=False) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(flat(x.get("content", [])) if isinstance(x, dict) else flat(x, True) for x in content)
    return "" if not inside or content is None else json.dumps(content)


def value(rng: random.Random, depth: int):
    kind = rng.randrange(7 if depth else 3)
    if kind < 3:
        return ["x y", "", 'q"\\\n', 7, True, None, "é"][rng.randrange(7)]
    if kind < 5:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"type": "t", "content": value(rng, depth - 1)} if kind == 5 else {"other": value(rng, depth - 1)}


def test_nested_content(spark):
    rng = random.Random(5)
    values = [value(rng, 6) for _ in range(300)] + [[], "", "s", {}, None, [[[[[[[["deep"]]]]]]]]]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = {r.k: r.text for r in nested.inline_text(spark.createDataFrame([*rows, (-1, "{no"), (-2, None)], "k long, c string"), "k", "c").collect()}
    assert got == {-1: "", -2: "", **{i: flat(v) for i, v in enumerate(values)}}
    assert nested.inline_text(spark.createDataFrame([], "k long, c string"), "k", "c").count() == 0


CHUNK = "item long, chunk_id string, parent_id string"


@pytest.mark.parametrize(
    "children, parents, titles, found, broken",
    [
        ([(2, "a", "p")], [(2, "p", ["a"])], [(2, "t")], [(2, 2)], {}),
        ([(2, "a", "p")], [(2, "p", ["a"])], [(2, None)], [], {}),
        ([(2, "a", "p")], [(2, "p", ["a"])], [(2, "t"), (3, None)], [(2, 1)], {"children": 1, "title_search": 1}),
        ([(2, "a", "q"), (2, "b", "p")], [(2, "p", ["a", "c"])], [(2, "t")], [(2, 2)], {"references": 2}),
        ([(2, "p", "p")], [(2, "p", ["p"])], [(2, "t")], [(2, 9), (2, 2)], {"references": 1}),
        ([(2, "a", "p")], [(3, "p", [])], [(2, "t")], [(2, 2)], {"references": 1}),
        ([(2, "a", "p"), (1, "x", "r")], [(2, "p", ["a"]), (1, "r", ["x"])], [(2, "t")], [(2, 2)], {"count_back": 1, "others": 1}),
    ],
)
def test_gates(spark, children, parents, titles, found, broken):
    table = Y.VersionedTable(spark, new_path(spark, "gates"))
    table.commit(spark.createDataFrame([(1, "o1", "o"), (1, "o2", "o"), (2, "old", "p")], CHUNK))
    hits = spark.createDataFrame(found, "item long, found long")
    rows = gates.load(
        table, spark.createDataFrame(children, CHUNK), spark.createDataFrame(parents, "item long, chunk_id string, child_ids array<string>"), spark.createDataFrame(titles, "item long, title string"), lambda asked: hits
    )
    assert {r.name: r.broken for r in rows.collect() if not r.ok} == broken
    assert rows.count() == 5
    held = sorted(r.chunk_id for r in table.read().collect())
    assert held == (["o1", "o2", "old"] if broken else ["a", "o1", "o2"])


def test_lost_rows_are_counted_back(spark):
    """Rows that the writer did not keep: the version holds less than was put in."""

    class Loses(Y.VersionedTable):
        def read(self, version=None):
            rows = super().read(version)
            return rows.where("chunk_id <> 'b'") if version == 2 else rows

    table = Loses(spark, new_path(spark, "gates"))
    table.commit(spark.createDataFrame([(1, "o1", "o")], CHUNK))
    children = spark.createDataFrame([(2, "a", "p"), (2, "b", "p")], CHUNK)
    rows = gates.load(table, children, spark.createDataFrame([(2, "p", ["a", "b"])], "item long, chunk_id string, child_ids array<string>"), spark.createDataFrame([(2, None)], "item long, title string"), lambda asked: asked.selectExpr("item", "item found"))
    assert {r.name: r.broken for r in rows.collect() if not r.ok} == {"count_back": 1}
    assert table.version() == 1


LEDGER = [(1, "active", "h", "m1"), (2, "soft_deleted", "h", "m2"), (3, "suspect_missing", "h", "m3"), (4, "active", "", "m4")]
JOBS = [(1, "mark_missing", "m1", "completed", 3), (3, "mark_missing", "m3", "running", 1), (1, "upsert", "m1", "failed", 2)]


def tables(spark):
    ledger = spark.createDataFrame(LEDGER, "k long, status string, print string, target string")
    return ledger, spark.createDataFrame(JOBS, "k long, job_type string, target string, status string, attempts int")


def test_delete_events(spark):
    ledger, jobs = tables(spark)
    gone = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "k long")
    for _ in range(2):
        ledger, jobs = Y.delete_by_event(ledger, jobs, gone, "k", "target")
        assert {r.k: r.status for r in ledger.collect()} == {1: "soft_deleted", 2: "soft_deleted", 3: "soft_deleted", 4: "active"}
        assert sorted(map(tuple, jobs.collect())) == [(1, "mark_missing", "m1", "pending", 0), (1, "upsert", "m1", "failed", 2), (3, "mark_missing", "m3", "running", 1)]


def test_repair_once(spark):
    ledger, jobs = tables(spark)
    off = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    ledger, jobs, first = Y.repair(ledger, jobs, off, "k", "print", "target")
    assert [r.k for r in first.collect()] == [1] and {r.k: r.print for r in ledger.collect()} == {1: "", 2: "h", 3: "h", 4: ""}
    assert (1, "upsert", "m1", "pending", 0) in set(map(tuple, jobs.collect()))
    assert Y.repair(ledger, jobs, off, "k", "print", "target")[2].count() == 0


def test_events_in_any_cut(spark):
    """Rows and jobs against one event after the other, for random events in batches of any size."""
    rng = random.Random(3)
    events = [(rng.randrange(8), i // 2, i, rng.choice(["error", "purchase", "view"])) for i in range(60)]
    state, asked = {k: ("active" if k < 3 else "soft_deleted") for k in range(5)}, set()
    for k, _, _, kind in events:
        if kind == "error" and state.get(k, "soft_deleted") != "soft_deleted":
            state[k] = "soft_deleted"
            asked.add((k, "mark_missing"))
        elif kind == "purchase":
            state[k] = "active"
            asked.add((k, "upsert"))
    for size in (60, 7):
        ledger = Changes(spark, new_path(spark, "ledger"), ["k"], "k long, status string", every=4)
        ledger.write(0, spark.createDataFrame([(k, "active" if k < 3 else "soft_deleted") for k in range(5)], "k long, status string"))
        got = set()
        for n, at in enumerate(range(0, 60, size), 1):
            rows = [(k, datetime.datetime(2024, 1, 1, 0, 0, s), i, kind) for k, s, i, kind in events[at : at + size]]
            batch = spark.createDataFrame(rows, "k long, ts timestamp, event_id long, event_type string")
            for _ in range(2):  # the batch comes again after a failure
                changed = Y.apply_events(ledger.read(n), batch, "k", route())
                ledger.write(n, changed.select("k", "status"))
            got |= {(r.k, job) for r in changed.collect() for job in r.jobs}
        assert {r.k: r.status for r in ledger.read().collect()} == state
        assert got == asked


def test_changes_read_back(spark):
    table = Changes(spark, new_path(spark, "changes"), ["k"], "k long, v string", every=3)
    assert table.read().count() == 0
    row = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    for n in range(7):
        table.write(n, row((n % 4, f"v{n}"), (9, None if n == 6 else "x")))
    assert {r.k: r.v for r in table.read().collect()} == {0: "v4", 1: "v5", 2: "v6", 3: "v3", 9: None}
    assert {r.k: r.v for r in table.read(2).collect()} == {0: "v0", 1: "v1", 9: "x"}
    assert [name for _, name in table._folders(None)] == ["full-5", "delta-6"]
