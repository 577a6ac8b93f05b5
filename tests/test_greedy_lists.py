"""Greedy pairs from lists of bounded length: the sequential result, and no links on disk."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from quarry.operators import pairs as P
from quarry.plans.registry import QUERIES
from quarry.sources.shared import shared_folder


def sequential(keys, v, least):
    """a, b and millionths, from the best pair down."""
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    m = np.rint(unit @ unit.T * 1e6).astype(int)
    every = sorted({(int(m[i, j]), min(keys[i], keys[j]), max(keys[i], keys[j])) for i in range(len(keys)) for j in range(i) if keys[i] != keys[j] and m[i, j] / 1e6 >= least}, reverse=True)
    used, found = set(), []
    for score, a, b in every:
        if not {a, b} & used:
            used |= {a, b}
            found.append((a, b, score / 1e6))
    return sorted(found)


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize(("k", "tile"), [(1, 40), (3, 40), (16, None)])
def test_lists_give_the_sequential_pairs(spark, k, tile, kind):
    """Whole numbers and copies have many ties; some keys stand for two vectors."""
    rng = np.random.default_rng(k)
    v = np.r_[rng.integers(-2, 3, size=(90, 4)), np.ones((12, 4), int), rng.integers(-2, 3, size=(20, 4))].astype(float)
    v = v[(v != 0).any(axis=1)]
    keys = rng.permutation(len(v))
    keys[:5] = keys[5:10]
    odd = [(1000, None), (1001, [0.0] * 4), (1002, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows = spark.createDataFrame([*((int(i), x.tolist()) for i, x in zip(keys, v)), *odd], f"k long, v array<{kind}>")
    got = sorted(map(tuple, P.greedy_pairs(rows, "k", "v", 0.3, k=k, tile=tile).collect()))
    assert got == sequential(keys.tolist(), v, 0.3)


def test_no_vectors_no_pairs(spark):
    found = P.greedy_pairs(spark.createDataFrame([], "k int, v array<float>"), "k", "v", 0.3)
    assert found.count() == 0 and found.dtypes == [("a", "int"), ("b", "int"), ("score", "double")]


def test_links_are_not_written(spark, tmp_path):
    """All 499,500 pairs of the vectors are links; what is written follows the vectors."""
    v = 1 + 0.3 * np.random.default_rng(2).normal(size=(1000, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = sorted((r.a, r.b, r.score) for r in QUERIES["d13_greedy_pairs"](spark, str(tmp_path)).collect())
    assert size() - before < 3_000_000
    assert got == sequential(list(range(1000)), v, 0.3)
