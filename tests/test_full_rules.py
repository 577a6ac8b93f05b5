"""Rules that the tables exercise only in part, on small cases."""

from __future__ import annotations

import datetime
import os

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA

from quarry.operators import build as B
from quarry.operators import catalog as K
from quarry.operators import curate as D
from quarry.operators import evaluate as E
from quarry.operators import logs as A
from quarry.operators import sync as Y
from quarry.operators.pairs import near_pairs
from quarry.plans.registry import QUERIES
from quarry.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_split_items(spark):
    notes = [(1, "before\n1. One\nbody a\nbody b\n- **2、 Two**\n\nbody c"), (2, "# 目录\n## Alpha\nx\n**Beta**\n## B\ny"), (3, "1. A one\nx\n1. A two\ny"), (4, "nothing here"), (5, None), (6, "0. Zero\nx\n## 7) Seven\n样例 line\n12. 样例\nlost")]
    rows = K.split_items(spark.createDataFrame(notes, "k int, t string"), "k", "t").orderBy("k", "item_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "001", "One", "body a\nbody b"), (1, "002", "Two", "body c"), (2, "001", "Alpha", "x"), (2, "002", "Beta", "## B\ny"),
        (3, "001", "A one", "x"), (3, "002", "A two", "y"), (6, "001", "Zero", "x"), (6, "007", "Seven", "样例 line"),
    ]


def test_attachments_and_links(spark):
    body = F.lit("[a\\_b\\.pptx](http://x/y) and\n- (talk%20one.pdf)\na_b.pptx\nno.txt\n")
    assert one(spark, K.attachments(body, (".pdf", ".ppt", ".pptx"))) == ["a_b.pptx", "talk one.pdf"]
    assert one(spark, K.doi(F.lit("see 10.1234/ab.c) and https://doi.org/10.9/x"))) == "https://doi.org/10.9/x"
    assert one(spark, K.doi(F.lit("see (10.1234/ab.c)"))) == "https://doi.org/10.1234/ab.c"
    assert one(spark, K.reader(F.lit("分享人：B\n阅读者: A "))) == "A" and one(spark, K.reader(F.lit("none"))) is None


def test_resolve_ids(spark):
    asked = spark.createDataFrame([(1, "7", "a"), (2, "", "a"), (3, None, "none"), (4, "x1", None)], "key int, explicit string, file string")
    catalog = spark.createDataFrame([("012", "a"), ("x9", "b")], "item_id string, file string")
    assert {r.key: r.item_id for r in K.resolve_ids(asked, catalog).collect()} == {1: "007", 2: "012", 3: "013", 4: "x1"}
    assert K.resolve_ids(asked.where("key = 3"), catalog.limit(0)).first().item_id == "001"


def test_newest_run_counts_whole(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    for run, n in (("run-1", 5), ("run-2", 8)):
        spark.range(n).repartition(3).withColumn("kind", F.lit("a")).write.parquet(f"{path}/{run}")
    spark.range(2).withColumn("kind", F.lit("b")).write.parquet(f"{path}/run-0")
    late = datetime.datetime(2040, 1, 1).timestamp()
    for name in os.listdir(tmp_path / "runs" / "run-1"):
        os.utime(tmp_path / "runs" / "run-1" / name, (late, late))
    read = S.with_file(spark.read.option("recursiveFileLookup", True).parquet(path))
    assert {r.variant: r["count"] for r in S.newest(read, F.col("kind")).groupBy("variant").count().collect()} == {"a": 5, "b": 2}


def test_work_list_is_idempotent(spark):
    jobs = spark.createDataFrame([("a", "completed", 2), ("b", "running", 1)], "k string, status string, attempts int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    state = lambda df: {r.k: (r.status, r.attempts) for r in df.collect()}
    once = Y.enqueue(jobs, asked, ["k"])
    assert state(once) == {"a": ("completed", 2), "b": ("running", 1), "c": ("pending", 0)} == state(Y.enqueue(once, asked, ["k"]))
    assert state(Y.enqueue(once, asked, ["k"], revive=True)) == {"a": ("pending", 0), "b": ("running", 1), "c": ("pending", 0)}


def test_walk_of_a_deep_tree_with_a_loop(spark, tmp_path):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n3"), ("other", "n1")], "parent string, child string")
    numbers = iter(range(100))

    def store(df):
        path = f"file://{tmp_path}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = Y.reachable(edges, spark.createDataFrame([("n0",)], "node string"), store)
    assert {r.node: r.depth for r in found.collect()} == {f"n{i}": i for i in range(10)}


def test_turn_taking(spark):
    rows = [(1, "tell me", "qa"), (2, "sum up 031", "summary"), (3, "and 032", "qa"), (4, "033 too", "qa"), (5, "why", "qa"), (6, "034?", "qa")]
    turns = spark.createDataFrame([(7, *r) for r in rows], "thread int, n int, text string, intent string")
    out = A.turn_taking(turns, "thread", "n", "text", "intent", ("summary",), other="qa", has_id="[0-9]{3}").orderBy("n").collect()
    assert [r.final_intent for r in out] == ["qa", "summary", "summary", "summary", "qa", "qa"]
    assert [r.needs_rewrite for r in out] == [False, False, True, True, True, False]


def test_captions(spark):
    said = lambda text: one(spark, B.caption_facts(F.lit(text)))
    full = said('```json\n{"summary": "s", "key_claims": ["a", "b", "c", "d", "e"], "confidence": "sure"}\n```')
    assert (full.summary, full.claims, full.confidence) == ("s", ["a", "b", "c", "d"], "medium")
    assert said('{"summary": "s", "key_claims": "a"}') is None and said("no braces") is None and said('{"key_claims": []}') is None
    assert said('x {"summary": "s", "key_claims": [], "confidence": "low"} y').confidence == "low"


def test_keyword_coverage(spark):
    c = one(spark, E.keyword_coverage(F.lit("The Quick, brown fox"), F.array(*map(F.lit, ("quick brown", "", "wolf", "FOX")))))
    assert (c.hit, c.total, c.missing) == (2, 3, ["wolf"])
    c = one(spark, E.keyword_coverage(F.lit("x"), F.lit(None).cast("array<string>")))
    assert (c.hit, c.total, c.missing) == (0, 0, [])


def test_all_keywords_count(spark):
    words = [f"w{i}e" for i in range(250)]
    c = one(spark, E.keyword_coverage(F.lit(" ".join(words[1:])), F.array(*map(F.lit, words))))
    assert (c.hit, c.total, c.missing) == (249, 250, ["w0e"])


def test_cross_lingual(spark):
    crossed = lambda q, *k: one(spark, E.cross_lingual(F.lit(q), F.array(*map(F.lit, k)).cast("array<string>")))
    assert crossed("这是什么", "model", "loss", "3.41") and not crossed("这是什么", "model", "3.41")
    assert not crossed("what is it", "model") and not crossed("这是什么") and not crossed("这是什么", "模型")


def test_near_pairs(spark):
    """Pairs of tiles against all pairs."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 32))
    v[100:200] = v[:100] + 0.6 * rng.normal(size=(100, 32))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for least in (0.3, 0.6):
        wanted = {(a, b) for a, b in np.argwhere(unit @ unit.T >= least).tolist() if a < b}
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
        pairs = [(r.a, r.b) for r in near_pairs(rows, "k", "v", least, tile=64).collect()]
        assert len(pairs) == len(set(pairs))
        assert all(abs(unit[a] @ unit[b] - least) < 2e-6 for a, b in set(pairs) ^ wanted)
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, [2.0, 2.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0])], "k long, v array<double>")
    assert sorted(map(tuple, near_pairs(odd, "k", "v", 0.9).collect())) == [(4, 5, 1.0), (4, 5, 1.0)]
    assert near_pairs(odd.limit(0), "k", "v", 0.9).count() == 0


def test_recall_of_dense_lsh(spark):
    exact = {(r.query_id, r.key) for r in QUERIES["r5_dense_topk"](spark, DATA).collect() if r["rank"] <= 10}
    found = {(r.query_id, r.key) for r in QUERIES["r5_dense_lsh"](spark, DATA).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
