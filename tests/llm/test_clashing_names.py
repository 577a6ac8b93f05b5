"""Columns whose names the operators use inside, odd rows through the pipeline, and language filters against exact sets."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, substring

INSIDE = ("__row", "__doc", "__body", "__at", "__n_words", "__n_hit", "__spans", "__items", "__cut", "body", "doc", "lang_pred", "score", "id", "key", "copy", "cut_id", "_cut_md5", "kept", "Batch", "text_md5")


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80))
    rows = [(1, words, "en"), (1, words, "en"), (2, words + " and more", "en"), (3, None, "en"), (4, "", None), (5, "12 34", None), (6, "the text of a row", None), (None, "a row without the id", "en")]
    rows += [(7, " ".join(reversed(words.split() * 800)), None), (8, "prefix " + words[:600] + " tail", None), (9, "das ist ein Text", "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("own").alias(name) for name in INSIDE])


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns(spark, odd, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, odd, DATA)
    assert out.columns == odd.columns
    assert {tuple(r) for r in out.select(*INSIDE).distinct().collect()} == {("own",) * len(INSIDE)}
    assert stage(spark, odd.limit(0), DATA).count() == 0


def test_odd_rows_through_all_stages(spark, odd):
    docs, ids = odd, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        ids[name] = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        if name == "language":
            assert ids[name] == sorted(["1", "1", "2", "6", "None", "7", "8", "9"])
        if name == "near_duplicates":
            assert ids[name] == sorted(["1", "1", "6", "None", "7", "9"])
    assert ids["tokens"] == sorted(["1", "1", "6", "None", "7", "9"])


def test_blocks_with_clashing_columns(spark, odd):
    bench = spark.createDataFrame([(1, "the text of a row"), (2, "das ist ein Text")], "item_id long, text string")
    out = decontaminate.decontaminate(odd, bench, block_words=4)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "1", "2", "3", "4", "5", "7", "8", "None"])
    assert substring.dedup_substrings(odd).where("text_md5 = 'own'").count() == odd.count()


def test_language_filters_against_exact_sets(spark):
    """The corrected popcounts follow exact counts over sets of n-grams, and so does the language chosen."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id")
    rows = docs.collect()
    grams = lambda plain, size: [plain[i : i + size] for i in range(len(plain) - size + 1)]
    texts = [langid._plain(r.text.encode() if r.text is not None else None) for r in rows]
    counts = {}
    for r, text in zip(rows, texts):
        if r.lang is not None:
            for size in langid.SIZES:
                counts.setdefault((size, r.lang), Counter()).update(grams(text, size))
    languages = sorted({lang for _, lang in counts})
    exact = {}
    for size in langid.SIZES:
        share = {lang: {g: n / counts[size, lang].total() for g, n in counts[size, lang].items() if n / counts[size, lang].total() >= langid.MIN_SHARE} for lang in languages}
        most = Counter()
        for lang in languages:
            for g, s in share[lang].items():
                most[g] = max(most[g], s)
        for lang in languages:
            exact[size, lang] = {g for g, s in share[lang].items() if s >= langid.FOREIGN * most[g]}
    model = langid.learn(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert model.languages == languages
    for r, text in zip(rows, texts):
        if not text:
            continue
        number = sum(max(0, len(text) - size + 1) for size in langid.SIZES)
        hits = np.array([sum(g in exact[size, lang] for size in langid.SIZES for g in grams(text, size)) for lang in languages])
        assert abs(found[r.doc_id].score - hits.max() / max(1, number)) < 0.03 + 2 / np.sqrt(max(1, number))
        if np.sort(hits)[-1] - np.sort(hits)[-2] > 0.05 * number + 3:
            assert found[r.doc_id].lang_pred == languages[hits.argmax()]
