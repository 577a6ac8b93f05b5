"""The whole ladder of `match` against a comparison of all pairs."""

from __future__ import annotations

import random
import re

from conftest import DATA

from quarry.operators import catalog as K
from quarry.plans.registry import QUERIES

FOLD = re.compile(r"[\s.,;:()\[\]{}<>\"'`!?/\\|~@#$%^&*+=_-]+")


def ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        to = [i]
        for j, y in enumerate(b, 1):
            to.append(min(row[j] + 1, to[-1] + 1, row[j - 1] + (x != y)))
        row = to
    return round(1 - row[-1] / max(len(a), len(b), 1), 6)


def brute(items, files, least=0.45):
    out = {}
    norm = lambda x: FOLD.sub("", (x or "").lower())
    for item, name in items:
        n, best = norm(name), []
        own = str(item).zfill(3)
        for file, file_name in files:
            fn = norm(file_name)
            score, held = ratio(n, fn), bool(n and fn) and (n in fn or fn in n)
            if name is not None and name == file_name:
                best.append((1, -1.0, file))
            if n and n == fn:
                best.append((2, -1.0, file))
            if held:
                best.append((3 if len(fn) >= 8 and fn not in K.GENERIC else 5, -score, file))
            if (file_name or "").startswith(own):
                best.append((4, -score, file))
            if n and fn and score >= least:
                best.append((6, -score, file))
        if best:
            rung, score, file = min(best)
            out[item] = (file, rung, -score)
    return out


def test_match_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "FUZZY_BLOCK", 40)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    name = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    items = [(i, name()) for i in range(1, 121)]
    thinned = lambda x: "".join(c for i, c in enumerate(x) if i % 5 != 4)
    files = [(i, thinned(x)) for i, x in items[:60]] + [(200 + i, name()) for i in range(40)]
    swapped = lambda x: "".join(c if i % 2 else "Z" for i, c in enumerate(x))
    files += [(300 + i, swapped(x)) for i, x in items[60:90]]
    long = "this name is much longer than the ten letters of its file deepsets"
    items += [(130, long), (131, "Paper"), (132, None), (133, ""), (134, "x" * 5), (7000, "nothing alike"), (135, "Graph-Nets"), (136, "graph nets")]
    files += [(400, "Deep Sets!"), (401, "all of a paper here"), (402, ""), (403, None), (404, "7000_qqqqqqqqqqqqqqqqqq"), (405, "xx"), (406, "graph nets"), (399, "graph nets")]
    got = K.match(spark.createDataFrame(items, "item int, name string"), spark.createDataFrame(files, "file int, file_name string")).collect()
    expected = brute(items, files)
    assert len(got) == len(expected)
    assert {r.item: (r.file, r.rung, r.score) for r in got} == expected
    assert {r for _, r, _ in expected.values()} >= {1, 2, 3, 4, 5, 6} and expected[130][1] == 3
    nothing = spark.createDataFrame([], "file int, file_name string")
    assert K.match(spark.createDataFrame(items, "item int, name string"), nothing).count() == 0


def test_query_finds_the_thinned_names(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    items = [(r.p_partkey, r.p_name) for r in parts]
    files = [(i, "".join(c for k, c in enumerate(x.lower()) if k % 5 != 4)) for i, x in items]
    rows = QUERIES["k4_match_files"](spark, DATA).collect()
    assert {r.item: (r.file, r.rung, r.score) for r in rows} == brute(items, files)
    assert len(rows) == len(items)
