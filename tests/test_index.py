"""Containment, BM25 and cosine best lists against plain versions, over several blocks and chunks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import contain, index


@pytest.mark.parametrize("block_chars", [1 << 20, 12])
def test_contained(spark, block_chars):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "ab" * 20_000), (None, "no id ab")]
    asked = [(i, "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 7)))) for i in range(40)] + [(50, ""), (51, None), (52, "ab"), (53, "ab"), (54, "b" * 30)]
    docs = spark.createDataFrame(texts, "doc long, text string").withColumn("word", F.lit("own"))
    passages = spark.createDataFrame(asked, "item long, text string").withColumn("word", F.lit("own"))
    got = [(r.item, r.doc) for r in contain.contained(docs, passages, key="doc", text="text", passage_key="item", passage="text", block_chars=block_chars).collect()]
    want = [(j, i) for i, t in texts for j, p in asked if t is not None and p and p in t]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = contain.contained(docs, passages.limit(0), key="doc", text="text", passage_key="item", passage="text")
    assert none.columns == ["item", "doc"] and none.count() == 0


def test_parts_of(spark):
    pieces = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "abc"), (4, None), (5, "bcdabc"), (5, "bcdabc")], "i long, piece string")
    texts = spark.createDataFrame([("x", "zabcdabcd"), ("y", "abc"), ("z", None)], "j string, text string")
    got = sorted((r.i, r.j) for r in contain.parts_of(pieces, texts, piece="piece", text="text", least=3).collect())
    assert got == [(1, "x"), (3, "x"), (3, "y"), (5, "x"), (5, "x")]


@pytest.mark.parametrize("words,chunk", [(1 << 18, 1 << 21), (20, 200)])
def test_bm25(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(index, "QUERY_WORDS", words)
    monkeypatch.setattr(index, "CHUNK", chunk)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 51), k=rng.randrange(1, 40)))) for i in range(400)]
    docs += [(400 + i, docs[3][1]) for i in range(30)] + [(500, None), (501, "only"), (502, "")]  # copies tie
    queries = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(25)] + [(30, docs[3][1]), (31, ""), (32, None), (33, "unknown words")]
    tokens = {i: re.findall("[a-z0-9]+", t or "") for i, t in docs}
    df = Counter(w for t in tokens.values() for w in set(t))
    average = sum(map(len, tokens.values())) / len(docs)
    keep = {i for i in tokens if i % 3}

    def expected(allowed):
        out = []
        for q, text in queries:
            scores = []
            for i in allowed:
                tf = Counter(tokens[i])
                s = sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(tokens[i]) / average)) for w in re.findall("[a-z0-9]+", text or "") if w in tf)
                if s > 0:
                    scores.append((-round(s, 6), i))
            out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:5], 1)]
        return sorted(out)

    forward = index.build(spark.createDataFrame(docs, "i long, text string").repartition(3), "i", F.col("text"))
    asked = spark.createDataFrame(queries, "q long, text string")
    for allowed, restrict in ((set(tokens), None), (keep, spark.createDataFrame([(i,) for i in keep], "key long"))):
        got = sorted((r.query_id, r.key, r.score, r.rank) for r in index.bm25(asked, forward, query_key="q", query_text="text", k=5, keep=restrict).collect())
        want = expected(allowed)
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
        assert np.allclose([s for *_, s, _ in got], [s for *_, s, _ in want], atol=2e-6)


@pytest.mark.parametrize("words,chunk", [(1 << 18, 1 << 21), (16, 64)])
def test_cosine(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(index, "QUERY_WORDS", words)
    monkeypatch.setattr(index, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 8)).round(3))] + [(300 + i, [1.0] * 8) for i in range(20)]
    odd = [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7)]
    df = spark.createDataFrame(vectors + odd, "i long, v array<float>")
    queries = [vectors[0], vectors[7], vectors[201]] + odd
    got = sorted((r.query_id, r.rank, r.key, r.score) for r in index.cosine_top(spark.createDataFrame(queries, "i long, v array<float>"), df, query_key="i", query_vector="v", key="i", vector="v", k=12).collect())
    want = []
    f32 = lambda v: np.array(v, np.float32).astype(float)
    for q, v in queries[:3]:
        scores = sorted((-round(float(f32(v) @ f32(w) / np.sqrt(f32(v) @ f32(v)) / np.sqrt(f32(w) @ f32(w))), 6), i) for i, w in vectors)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:12], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)


def test_weighted_terms(spark):
    rows = [(1, "a b", "a c 检索"), (2, None, "c c"), (2, "C", "c d"), (None, "x", "x"), (None, "x", None), (3, "", None), (7, "n", "7 7")]
    weights = {"title": 3, "id": 2, "text": 1}

    def found(part):
        got = index.weighted_terms(spark.createDataFrame(part, "id int, title string, text string"), "id", weights)
        return got, sorted(map(tuple, got.select("key", "term", "tf").collect()), key=str)

    want = Counter()
    for i, title, text in rows:
        for field, w in ((title, 3), (None if i is None else str(i), 2), (text, 1)):
            words = re.findall("[a-z0-9]+", (field or "").lower()) + (["检", "索", "检索"] if "检" in (field or "") else [])
            want.update({(i, x): w * n for x, n in Counter(words).items()})
    df, got = found(rows)
    assert got == sorted(((*k, n) for k, n in want.items()), key=str) and df.columns == ["key", "term", "tf"]
    single = [r for r in rows if r[0] not in (2, None)]
    df, got = found(single)
    assert got == sorted(((*k, n) for k, n in want.items() if k[0] not in (2, None)), key=str)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()  # keys that are unique are never shuffled
