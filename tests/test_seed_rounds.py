"""Seed clusters made in rounds against the same clusters made one by one."""

from __future__ import annotations

import random

import pytest
from conftest import DATA

from quarry.operators import curate as D
from quarry.operators.pairs import near_pairs
from quarry.plans.curation import PAIR_LEAST, _checkpoint
from quarry.plans.registry import QUERIES


def one_by_one(ids, edges, size):
    near: dict = {}
    for a, b, score in edges:
        near.setdefault(a, []).append((score, b))
        near.setdefault(b, []).append((score, a))
    left, out = set(ids), []
    for seed in sorted(ids):
        if seed not in left:
            continue
        left.discard(seed)
        for score, other in sorted((e for e in near.get(seed, []) if e[1] in left), reverse=True)[: size - 1]:
            left.discard(other)
            out.append((seed, other, score))
    return sorted(out)


CHAIN = [(i, i + 1, 0.5 + i / 100) for i in range(1, 12)]
STAR = [(1, i, 0.9) for i in range(2, 9)]
CLIQUE = [(a, b, 0.7) for a in range(1, 9) for b in range(a + 1, 9)]


def cloud():
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(160)}
    return [(a, b, rng.choice([0.3, 0.4, 0.5, 0.6])) for a, b in sorted(pairs)]


@pytest.mark.parametrize("edges", [CHAIN, STAR, CLIQUE, cloud(), []], ids=["chain", "star", "clique", "cloud", "none"])
def test_rounds_equal_one_by_one(spark, edges):
    ids = range(90)
    vertices = spark.createDataFrame([(i,) for i in ids], "v long")
    got = D.seed_clusters(vertices, spark.createDataFrame(edges, "a long, b long, score double"), 3, _checkpoint(spark))
    assert sorted(tuple(r) for r in got.collect()) == one_by_one(ids, edges, 3)


def test_query_equals_one_by_one(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    edges = [tuple(r) for r in near_pairs(vectors, "vec_id", "embedding", PAIR_LEAST).collect()]
    expected = one_by_one([r.vec_id for r in vectors.collect()], edges, 3)
    got = sorted((r.seed, r.vec_id, r.score) for r in QUERIES["d14_seed_clusters"](spark, DATA).collect())
    assert got and got == expected
