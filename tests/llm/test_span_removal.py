"""Decontamination cuts benchmark passages out of documents that it keeps."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
import pytest

from quarry.llm import decontaminate


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_spans_leave_long_documents(spark, block_words):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other, head, tail = words(200), words(14), words(2400), words(2400)
    texts = [
        (1, f"{head}\n\nÉté: {passage.upper()}. {tail}\n"),  # 200 of 5,001 words, in the middle
        (2, f"{other}, {head} {tail} {passage}"),  # at both ends
        (3, f"{head} yes {tail}"),  # a one-word item: hit, but shorter than a span that is cut
        (4, f"{passage} {words(100)}"),  # above the coverage limit
        (5, None),
        (6, "  odd — space\n"),
    ]
    docs = spark.createDataFrame([(i, "own", t) for i, t in texts], "doc_id long, kept string, text string")
    bench = spark.createDataFrame([("a", passage), ("b", other), ("c", "yes")], "item_id string, text string")
    clean = decontaminate.decontaminate(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    expected = {1: f"{head}\n\nÉté: {tail}\n", 2: f"{head} {tail} ", 3: texts[2][1], 5: None, 6: texts[5][1]}
    assert got == expected
    left = decontaminate.benchmark_hits(clean, bench, block_words=block_words).where("n_hit >= 13")
    assert left.count() == 0


def test_benchmarks_stage_cuts(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(20))
    prose = [" ".join(f"p{k}x{i}" for i in range(500)) for k in range(2)]
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{prose[0]} {passage} {prose[1]}")], "doc_id long, text string")
    assert pipeline.benchmarks(spark, docs, str(tmp_path)).first().text == " ".join(prose)
