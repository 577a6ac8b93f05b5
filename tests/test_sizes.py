"""Plans and steps whose size must not grow faster than the input."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F

from quarry.operators import index, pairs
from quarry.operators.evaluate import keyword_coverage
from quarry.operators.retrieve import dense_lsh
from quarry.plans.registry import QUERIES


def test_grams_of_answers_are_not_broadcast(spark):
    df = QUERIES["e6_title_citation"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastExchange" not in plan


def one_by_one(vectors, least, size):
    left, out = sorted(vectors), []
    while left:
        seed = left.pop(0)
        near = sorted(((round(float(vectors[seed] @ vectors[x]), 6), x) for x in left), reverse=True)
        for score, other in [n for n in near if n[0] >= least][: size - 1]:
            left.remove(other)
            out.append((seed, other, score))
    return sorted(out)


def test_clusters_of_copies_and_short_lists_equal_one_by_one(spark):
    """Blocks that end early, since the seeds of a group of copies want the same neighbours."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 8))
    v[20:70] = v[20]
    vectors = {i: x / np.sqrt(x @ x) for i, x in enumerate(v)}
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in vectors.items()], "i long, v array<double>").repartition(3)
    for seeds, listed in ((64, 128), (5, 20), (4096, 1 << 17)):
        got = pairs.seed_clusters(rows, "i", "v", 0.4, 3, seeds=seeds, listed=listed)
        assert sorted((r.seed, r.member, r.score) for r in got.collect()) == one_by_one(vectors, 0.4, 3)
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None])], "i long, v array<double>")
    assert pairs.seed_clusters(odd, "i", "v", 0.4, 3).count() == 0


def test_links_of_clusters_are_not_written(spark):
    """Half a million links between copies, of which nothing but the vectors and the clusters comes to the shared folder."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    rows = spark.range(1000).selectExpr("id AS i", "array(1.0D, id / 1e6D) AS v")
    before = size()
    assert pairs.seed_clusters(rows, "i", "v", 0.9, 3).count() == 666
    assert size() - before < 2_000_000


def test_pairs_of_a_band_are_not_rows(spark):
    """Vectors that share all bands: every pair of query and vector meets, but they are no rows of a shuffle; zero vectors take no part."""
    rows = spark.range(3000).selectExpr("id AS i", "IF(id = 5, array(0.0D, 0.0D), array(1.0D, id / 1e4D)) AS v")
    got = dense_lsh(rows.where("i % 100 = 0"), rows, key="i", vector="v", width=2, k=3)
    top = {(r.query_id, r.rank): r.key for r in got.collect()}
    assert len(top) == 90 and top[0, 1] == 0 and top[2900, 1] <= 2900
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert 5 not in top.values()


def test_a_slice_of_words_bounds_the_index_step():
    """A batch of 3 million words goes through in slices; tracemalloc sees the arrays of numpy."""
    docs = pa.RecordBatch.from_pydict({"key": list(range(10_000)), "words": [[f"w{i}" for i in range(300)]] * 10_000})
    tracemalloc.start()
    rows = sum(b.num_rows for b in index._forward(iter([docs])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 40 << 20


def test_slices_give_the_same_index_and_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    asked = docs.where("doc_id < 20").selectExpr("doc_id AS q", "left(text, 200) AS t")

    def found():
        corpus = index.build(docs, "doc_id", F.col("text"))
        best = index.bm25(asked, corpus, query_key="q", query_text="t", k=5)
        return sorted(map(str, corpus.rows.collect())), sorted(map(tuple, best.collect()))

    whole = found()
    assert index._cuts(np.array([3, 1, 9, 2, 2, 2]), 4) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    monkeypatch.setattr(index, "WORDS", 500)
    monkeypatch.setattr(index, "MEETINGS", 50)
    assert whole[1] and whole == found()


def test_an_answer_is_folded_once_for_all_keywords(spark):
    rows = spark.createDataFrame([("The cat sat", ["cat", "dog", "!", None]), (None, ["a"]), ("x", None)], "a string, k array<string>")
    df = rows.select(keyword_coverage(F.col("a"), F.col("k")).alias("c"))
    assert [(r.c.hit, r.c.total, r.c.missing) for r in df.collect()] == [(1, 2, ["dog"]), (0, 1, ["a"]), (0, 0, [])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(a#") == 1
