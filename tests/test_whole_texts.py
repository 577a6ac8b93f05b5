"""Reranking takes whole texts, however late the words of a passage come in them."""

from __future__ import annotations

import duckdb
import pytest
from conftest import same_rows

from quarry.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def late(spark, tmp_path):
    """Two documents; the words of the passages come after 1,500 characters in one of them."""
    passage = "alpha beta gamma delta"
    texts = [(1, "filler " * 220 + passage), (2, "alpha " + "other " * 300), (3, None)]
    docs = [(i, text, "en", "src0", len(text or "")) for i, text in texts]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (3, "nothing here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def test_rerank_scores_are_of_whole_texts(spark, late):
    folder, con = late
    got = {(r.query_id, r.key): (r.rerank_score, r.new_rank) for r in QUERIES["r11_rerank"](spark, folder).collect()}
    assert got == {(1, 1): (round(8 / 9, 6), 1), (1, 2): (round(2 / 6, 6), 2)}
    same_rows(QUERIES["r11_rerank"](spark, folder), con.sql(ORACLE_SQL["r11_rerank"]))


def test_an_override_looks_at_whole_texts(spark, late):
    folder, con = late
    spark.createDataFrame([(1, "filler " * 220 + "alpha beta gamma delta", "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    (row,) = QUERIES["r14_item_override"](spark, folder).collect()
    assert (row.query_id, row.hits, row.confident, row.item_filter) == (1, 1, True, True)
    same_rows(QUERIES["r14_item_override"](spark, folder), con.sql(ORACLE_SQL["r14_item_override"]))


def test_the_verdict_keeps_its_beginning_of_texts(spark, late):
    folder, con = late
    same_rows(QUERIES["r12_verdict"](spark, folder), con.sql(ORACLE_SQL["r12_verdict"]))
