"""The mix: targets, schedule and pieces against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import BLOCK, GOLDEN, POINT_BITS, mix, point, targets

SCHEMA = "doc_id long, text string, source string, size long, row long, words long, s string, n long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, "own", 7) for r in rows], SCHEMA)


def filled(sizes, weights, most=2):
    """The rounds of the contract: what is over a cap is shared out among the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) for s in full} | share
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 77}, {"x": 1, "y": 1}, {f"s{i}": (i * 37) % 101 for i in range(40)}, {"é": 5, "z": 900, "Z": 0, "": 40}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("" if s is None else "=" + s, n) for s, n in sizes.items()], "s string, size long")
    got = {r.s[1:] if r.s else None: r.target for r in targets(rows).collect()}
    want = filled(sizes, (3, 1, 2))
    assert got.keys() == want.keys()
    for s, t in want.items():
        assert got[s] == pytest.approx(float(t), abs=1e-6)


def test_points(spark):
    ts = [0, 1, 2, 12345, (1 << 31) - 1, 1 << 31, (1 << 40) + 17, (1 << 61) + 5]
    df = spark.createDataFrame([(t,) for t in ts], "t long")
    assert {r.t: r.u for r in df.select("t", point(F.col("t")).alias("u")).collect()} == {t: t * GOLDEN % (1 << POINT_BITS) for t in ts}


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None, "tiny"] if i < 290 else ["a"])
        rows.append((i, " ".join(f"w{j}" for j in range(rng.choice([0, 1, 3, 20, 50]))), source))
    rows += [(500, None, "a"), (501, "\t\n ", "empty source"), (None, "no id here", "b"), (None, "no id here", "b"), (700, "w0 w1 w2", "a"), (700, "w0 w1 w2", "a")]
    rows += [(502, "x y z " * 3000, "c")]
    return rows


def test_pieces_of_the_mix(spark, case):
    mixed = mix(documents(spark, case), block=64)
    rows = {r.row: r for r in mixed.rows.collect()}
    pieces = mixed.pieces.collect()
    assert sorted(((r.id is None, r.id or 0), r.size) for r in rows.values()) == sorted(((i is None, i or 0), len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])) for i, t, _ in case)
    source = {}
    for i, _, s in case:
        source.setdefault(i, s)
    taken, per_slot, seen = Counter(), defaultdict(int), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and 0 <= p.first and p.first + p.length <= rows[p.row].size
        taken[p.row] += p.length
        per_slot[p.slot] += p.length
        seen[p.row].append((p.first, p.length))
    goal = {}
    by_source = Counter()
    for r in rows.values():
        goal[source[r.id]] = r.target
        by_source[source[r.id]] += taken[r.row]
        assert taken[r.row] <= 2 * r.size
        covered = Counter(x for first, n in seen[r.row] for x in range(first, first + n))
        assert not covered or max(covered.values()) <= 2
    for s, target in goal.items():
        assert abs(by_source[s] - target) <= 0.5 + 1e-6
    sizes = Counter()
    for r in rows.values():
        sizes[source[r.id]] += r.size
    want = filled(dict(sizes), (3, 1, 2))
    assert goal == pytest.approx({s: float(t) for s, t in want.items()})
    # every source is at its share after any number of slots, but for a few slots
    times = sorted(per_slot)
    assert times == list(range(len(times)))
    row_source = {row: source[r.id] for row, r in rows.items()}
    at = defaultdict(Counter)
    for p in pieces:
        at[p.slot][row_source[p.row]] += p.length
    assert all(len(c) == 1 for c in at.values())
    total, sums = sum(goal.values()), Counter()
    for n, t in enumerate(times, 1):
        sums.update(at[t])
        for s, g in goal.items():
            assert abs(sums[s] - n * 64 * g / total) <= 6 * 64
    # two runs are equal
    again = mix(documents(spark, case).repartition(5), block=64)
    assert sorted(map(tuple, again.pieces.select("slot", F.coalesce("id", F.lit(-1)), "first", "length").collect())) == sorted((p.slot, -1 if p.id is None else p.id, p.first, p.length) for p in pieces)


def test_nothing_to_mix(spark):
    docs = documents(spark, [(1, None, "a"), (2, " ", None)])
    mixed = mix(docs)
    assert sorted((r.id, r.size, r.target) for r in mixed.rows.collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mixed.pieces.count() == 0
    assert mix(docs.limit(0)).rows.count() == 0


def test_one_word(spark):
    mixed = mix(documents(spark, [(1, "word", "a"), (2, "a b c", "b")]), block=BLOCK)
    taken = Counter()
    for p in mixed.pieces.collect():
        taken[p.id] += p.length
    assert taken == {1: 2, 2: 4}  # 150 % of four words; the first source stops at twice its size
