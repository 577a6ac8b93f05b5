"""Ranks and running sums against sequential versions, with a key that holds most rows, null keys, ties and clashing names."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators.ranks import running


def expected(rows):
    """rows: (key, order, value); key -> sorted list of (order, rank, running sum)."""
    groups = defaultdict(list)
    for k, o, v in rows:
        groups[k].append((o, v))
    out = defaultdict(list)
    for k, members in groups.items():
        total = 0
        for i, (o, v) in enumerate(sorted(members), 1):
            total += v
            out[k].append((o, i, total))
    return out


@pytest.mark.parametrize("partitions", ["1", "7", "23"])
def test_running_with_a_hot_key(spark, partitions):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice([None, "a", "b", "c"]), i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*r, "own", 1, 2, 3) for r in rows], "key string, o long, v long, k string, p long, at long, n long").repartition(9)
        out = running(df, ["key"], [F.col("o")], rank="r", sums={"upto": "v"}, unique="u").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = defaultdict(list)
    for x in out:
        assert (x.k, x.p, x.at, x.n) == ("own", 1, 2, 3)
        got[x.key].append((x.o, x.r, x.upto))
    want = expected(rows)
    assert {k: sorted(v) for k, v in got.items()} == dict(want)
    assert len({x.u for x in out}) == len(rows)
    hot = sorted((x for x in out if x.key == "hot"), key=lambda x: x.u)
    assert [x.o for x in hot] == sorted(x.o for x in hot)


def test_whole_table_as_one_group(spark):
    df = spark.range(500).repartition(5)
    got = sorted((r.id, r.rank, r.total) for r in running(df, [], [F.desc("id")], sums={"total": "id"}, keep=["id"]).collect())
    total, want = 0, []
    for rank, i in enumerate(range(499, -1, -1), 1):
        total += i
        want.append((i, rank, total))
    assert got == sorted(want)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1)], "k string, o long")
    assert sorted((r.k, r.rank) for r in running(df, ["k"], [F.col("o")]).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert running(df.limit(0), ["k"], [F.col("o")]).count() == 0


def test_no_task_sorts_a_key(spark):
    """The window is over parts of a key."""
    df = spark.createDataFrame([("a", 1)], "k string, o long")
    plan = running(df, ["k"], [F.col("o")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "__part" in plan.split("Window", 1)[1]
