"""Operators that SQL cannot express, against plain Python, and small cases with known results."""

from __future__ import annotations

import math

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import build as B
from quarry.operators import catalog as K
from quarry.operators import curate as D
from quarry.operators import evaluate as E
from quarry.operators import logs as A
from quarry.operators import retrieve as R
from quarry.operators import sync as Y
from quarry.operators.pairs import near_pairs
from quarry.plans.registry import QUERIES


def test_tokens_of_cjk(spark):
    row = spark.sql("select 'RAG 检索,增强 v2' as t").select(X.tokens(F.col("t")).alias("w")).first()
    assert row.w == ["rag", "v2", "检", "索", "增", "强", "检索", "索增", "增强"]


@pytest.mark.parametrize(
    ("text", "expected"), [("没有找到相关论文", True), ("不能基于资料库回答", True), ("没有发现显著影响", False), ("The result holds.", False), (None, False)]
)
def test_refusals(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.refuses(F.col("t"))).first()[0] is expected


def test_char_limit(spark):
    df = spark.createDataFrame([("",), ("中" * 600,), ("a" * 600,), ("." * 10,)], "t string")
    assert [r[0] for r in df.select(X.char_limit(F.col("t"))).collect()] == [1434, 471, 1234, 370]


def test_sentence_packing():
    text = "One. " * 400 + "x" * 3000 + ". Last one here."
    parts = B.pack_sentences(text)
    assert "".join("".join(parts).split()) == "".join(text.split())  # I1
    long = "One. " + "x" * 3000 + "."  # a cut sentence keeps to the limit of the whole one
    assert all(len(p) <= B._limit(len(p), *B._weight(p)) or p in long for p in parts)  # I2
    assert B.pack_sentences("   ") == []


def test_parents_keep_sections_and_size(spark):
    rows = QUERIES["c15_parents"](spark, DATA).orderBy("doc_id", "seq").collect()
    chunks = {(r.doc_id, r.seq): r for r in QUERIES["c14_children"](spark, DATA).collect()}
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.doc_id, r.parent_no), []).append(r)
    for (doc, _), members in groups.items():
        assert len({chunks[doc, m.seq].section_no for m in members}) == 1
        assert len(members) == 1 or sum(m.n_chars + 2 for m in members) <= B.PARENT_CHARS
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r.seq)
    assert all(seqs == list(range(1, len(seqs) + 1)) for seqs in by_doc.values())  # I4


def test_anchored_windows(spark):
    got = {r.event_id: (r.window_start, r.nth, r.over) for r in QUERIES["a12_anchored_windows"](spark, DATA).collect()}
    streamed = {r.event_id: (r.window_start, r.nth, r.over) for r in QUERIES["t7_anchored_windows"](spark, DATA).collect()}
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    expected, state = {}, {}
    for r in events.orderBy("user_id", "us", "event_id").collect():
        start, n = state.get(r.user_id, (None, 0))
        if start is None or r.us - start >= 3600 * 10**6:
            start, n = r.us, 0
        state[r.user_id] = start, n + 1
        expected[r.event_id] = start, n + 1, n + 1 > 3
    assert got == expected
    assert streamed == expected


def test_dense_lsh_recall(spark):
    exact = {(r.query_id, r.key) for r in QUERIES["r5_dense_topk"](spark, DATA).collect()}
    found = {(r.query_id, r.key) for r in QUERIES["r5_dense_lsh"](spark, DATA).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_greedy_pairs(spark):
    edges = near_pairs(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding", 0.3)
    every = sorted(((r.score, r.a, r.b) for r in edges.collect()), reverse=True)
    used, expected = set(), set()
    for _, a, b in every:
        if not {a, b} & used:
            used |= {a, b}
            expected.add((a, b))
    assert {(r.a, r.b) for r in QUERIES["d13_greedy_pairs"](spark, DATA).collect()} == expected


def test_seed_clusters(spark):
    rows = QUERIES["d14_seed_clusters"](spark, DATA).collect()
    members = [r.vec_id for r in rows]
    assert len(members) == len(set(members))
    assert not {r.seed for r in rows} & set(members)
    sizes: dict = {}
    for r in rows:
        assert r.score >= 0.3
        sizes[r.seed] = sizes.get(r.seed, 1) + 1
    assert all(2 <= n <= 3 for n in sizes.values())  # I6


def test_stratified(spark):
    rows = QUERIES["d3_stratified"](spark, DATA).collect()
    assert len(rows) == 100 and len({r.doc_id for r in rows}) == 100
    assert {r.lang for r in rows} == {"en", "de", "fr", "es"}
    assert D.allocate({"a": 98, "b": 1, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert len(QUERIES["d12_quota_sample"](spark, DATA).collect()) == 60


def test_hold_out_does_not_leak(spark):
    rows = QUERIES["d7_group_hold_out"](spark, DATA).collect()
    held = {r.conv_id for r in rows if r.split == "held"}
    assert held and not held & {r.conv_id for r in rows if r.split == "train"}


def test_match_rungs(spark):
    items = spark.createDataFrame([(1, "Deep Sets"), (2, "graph networks"), (3, "attention is all you need"), (4, "unrelated")], "item int, name string")
    files = spark.createDataFrame([(1, "Deep Sets"), (2, "Graph-Networks"), (3, "attention is all"), (4, "zzzz")], "file int, file_name string")
    got = {r.item: (r.file, r.rung) for r in K.match(items, files).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3)}
    assert QUERIES["k4_match_files"](spark, DATA).where("item = file").count() > 0


def test_verdict(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    ranked = spark.createDataFrame([(1, 0.9), (1, 0.2), (2, 0.5), (3, None)], "query_id int, rerank_score double")
    got = {r.query_id: (r.confident, r.reason) for r in R.verdict(queries, ranked, F.lit(0.8)).collect()}
    assert got == {1: (True, "ok"), 2: (False, "below_gate"), 3: (True, "not_reranked"), 4: (False, "empty")}


def test_context_window(spark):
    parent = "a" * 2000 + "needle" + "b" * 2000
    rows = [("needle" + "b" * 50, parent), ("missing", parent), ("a", "short parent")]
    df = spark.createDataFrame(rows, "c string, p string")
    got = [r[0] for r in df.select(R.window_of(df, "c", "p")).collect()]
    assert "needle" in got[0] and got[0].startswith("……") and got[0].endswith("……") and len(got[0]) == 1204
    assert got[1] == parent[:1200] + "……"
    assert got[2] == "short parent"


def test_small_to_big(spark):
    hits = spark.createDataFrame([(1, "c1", 1, "p1", "x"), (1, "c2", 2, "p1", "y"), (1, "c3", 3, "p9", "z"), (1, "c4", 4, None, "w")], "query_id int, key string, rank int, parent_id string, text string")
    parents = spark.createDataFrame([("p1", "whole x")], "parent_id string, parent_text string")
    got = {r.key: r.context for r in R.small_to_big(hits, parents, 10).collect()}
    assert got == {"c1": "whole x", "c3": "z", "c4": "w"}


def test_citation_numbers_go_on(spark):
    uses = spark.createDataFrame([("t", 1, "b"), ("t", 1, "a"), ("t", 2, "c"), ("t", 3, "a"), ("u", 1, "c")], "thread string, ord int, source string")
    got = {(r.thread, r.source): r.number for r in R.citation_numbers(uses).collect()}
    assert got == {("t", "a"): 1, ("t", "b"): 2, ("t", "c"): 3, ("u", "c"): 1}


def test_sweep_equals_brute_force(spark):
    rows = [(i / 37 % 1, i % 3 > 0) for i in range(200)]
    got = E.sweep(spark.createDataFrame(rows, "s double, p boolean"), "s", "p").collect()
    for r in got:
        pos = [s >= r.cut for s, p in rows if p]
        neg = [s < r.cut for s, p in rows if not p]
        assert r.pass_rate == pytest.approx(sum(pos) / len(pos), abs=1e-4)
        assert r.reject_rate == pytest.approx(sum(neg) / len(neg), abs=1e-4)


def test_index_quantiles(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 7.0, 2.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = E.index_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).first()
    v = sorted(values)
    assert (row.p10, row.p50, row.p90) == tuple(v[min(len(v) - 1, int(len(v) * q))] for q in (0.1, 0.5, 0.9))


def test_error_classes(spark):
    cases = {"Error code: 429": "model_rate_limit", "Read timed out": "timeout_error", "Invalid API key": "model_auth_error", "?": "internal_error"}
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    assert [r[0] for r in df.select(A.error_class(F.col("m"))).collect()] == list(cases.values())


def test_versioned_table_keeps_old_version_on_failure(spark, tmp_path):
    table = Y.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.commit(spark.range(3)) == 1
    with pytest.raises(ValueError, match="broken"):
        table.commit(spark.range(5), Y.expectation("broken", spark.range(1)))
    assert table.version() == 1 and table.read().count() == 3
    assert table.commit(spark.range(4), Y.expectation("fine", spark.range(0))) == 2
    assert table.read().count() == 4


def test_two_strikes(spark):
    ledger = spark.createDataFrame([(1, "active", 0), (2, "suspect_missing", 1), (3, "soft_deleted", 2), (4, "active", 0), (5, "purged", 0)], "id int, status string, missing_count int")
    got = {r.id: (r.status, r.missing_count) for r in Y.strike(ledger, spark.createDataFrame([(4,)], "id int"), "id").collect()}
    assert got == {1: ("suspect_missing", 1), 2: ("soft_deleted", 2)}


def test_upsert_keeps_old_value_where_new_is_blank(spark):
    old = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    new = spark.createDataFrame([(1, "", "c"), (2, "n", "m")], "id int, x string, y string")
    assert {tuple(r) for r in Y.upsert(old, new, "id").collect()} == {(1, "a", "c"), (2, "n", "m")}


def test_fusion_scores(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, key string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, key string, rank int")
    got = R.fuse([one, two], 3).collect()
    assert [r.key for r in got] == ["b", "a", "c"]
    assert math.isclose(got[0].score, 1 / 61 + 1 / 62, abs_tol=1e-9)
