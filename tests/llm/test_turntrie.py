"""The trie of conversations against a sequential version; list ranking against a walk."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.turntrie import places, rebuilt, trie, turns

SCHEMA = "conv_id long, turn long, role string, text string, c long, pos string, key string, words string, node long, place long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "own", "own", "own", 7, 7) for r in rows], SCHEMA)


def brute(rows):
    """The contract, conversation by conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in cs if whole[c] == node)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), sum(not children[n] for n in under), saved, sha))
    return sorted(out, key=str)


def built(spark, rows):
    found, convs = rebuilt(turns(conversations(spark, rows)))
    return sorted((tuple(r) for r in trie(found, convs).drop("key").collect()), key=str)


def test_odd_conversations(spark):
    rows = [(0, 0, "system", "a"), (0, 1, "user", "b b"), (0, 2, "user", "c"), (0, 3, None, None), (20, None, "user", "first"), (20, 0, "user", "x"), (20, 0, "user", "x"), (20, 0, "user", "w")]
    rows += [(c, t, "user", f"t{t}") for c in range(1, 8) for t in range(c % 4)] + [(100 + c, t, "", "same") for c in range(30) for t in range(3)]
    rows += [(None, 1, "user", "lost"), (45, 1, "user", ""), (46, 1, "user", None), (47, 1, None, ""), (-3, 1, "user", "a b"), (200, 0, "user", "long " * 50_000)]
    rows += [(300, t, "user", f"turn {t % 5}") for t in range(700)]
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.choice([None, 0, 1, 2, 3]), rng.choice("ua"), rng.choice(["x", "y y", "z", "", None])) for _ in range(400)]
    rows += [(61, i, "u", "x") for i in range(250)]
    assert built(spark, rows) == brute(rows)


def test_nothing(spark):
    assert built(spark, []) == [] and built(spark, [(None, 0, "user", "x")]) == []


@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_list_ranking(spark, n):
    order = list(range(10, 10 + n))
    random.Random(n).shuffle(order)
    arcs = [(x, order[i - 1] if i else None, order[i + 1] if i + 1 < n else None) for i, x in enumerate(order)]
    found = places(spark.createDataFrame(arcs, "id long, before long, after long"), short=8)
    assert {r.id: r.place for r in found.collect()} == {x: i for i, x in enumerate(order)}
    assert found.agg(F.count("*")).first()[0] == n
