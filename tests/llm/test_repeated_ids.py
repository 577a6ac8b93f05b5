"""Rows that repeat an id with other texts, texts without letters, and bytes that are no text."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from conftest import DATA
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, minhash


def test_rows_of_one_id_are_linked_by_their_own_texts(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    t, u = words("t", 60), words("u", 60)
    rows = [(3, t), (5, t + " more"), (5, u), (6, u), (6, None), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, text_hash="hash").withColumn("t", F.col("hash") == F.lit(docs.where("doc_id = 3").select(minhash.hash_of(F.col("text"))).first()[0]))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found.collect())
    assert got == sorted([("3", 58, "3", True), ("5", 59, "3", False), ("5", 58, "5", True), ("6", 58, "5", False), ("6", 0, "6", True), ("None", 58, "None", True)])
    assert found.where("t").count() == 2


def test_repeated_ids_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(rng.randrange(1, 4)):
            edit = [w if rng.random() > 0.01 else "x" for w in base]
            rows.append((rng.randrange(25), " ".join(edit)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(78)} for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root, changed = [low if r == high else r for r in root], True
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((rows[i][0], least[root[i]]) for i in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == want


def test_stage_keeps_one_text_of_each_group(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    t, u = words("t", 60), words("u", 60)
    docs = spark.createDataFrame([(3, t), (5, t + " more"), (5, u), (6, u)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, DATA).collect()) == [(3, t), (5, u)]


def test_signs_are_no_letters(spark):
    learnt = spark.createDataFrame([(i, f"das ist ein Text {i}", "de") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.learn(learnt)
    rows = [(1, "²½ ³"), (2, "Ⅷ ½ 12"), (3, "das ist ² ein"), (4, None), (5, "ª"), (6, "字")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("und", "und", "de", "und")


def test_bytes_that_are_no_text(spark):
    bad = spark.createDataFrame([(1, bytearray(b"das ist \xff ein Text"))], "doc_id long, text binary")
    model = langid.learn(spark.createDataFrame([(1, "das ist ein Text", "de")], "doc_id long, text string, lang string"))
    assert langid.predict(bad, model).first().lang_pred == "de"
    assert bpe.encode(bad, bpe.default_vocab()).first().n_tokens > 0
