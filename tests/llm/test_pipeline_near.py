"""The pipeline's near-duplicate stage: five-word shingles, similarity 0.8 or more."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from conftest import DATA

from quarry.llm import minhash


def test_stage_links_at_five_words_and_four_fifths(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, dropped = [], set()
    base = words(1000)
    texts += [(1, base), (2, base + words(220))]  # 996 of 1216 shingles of five words: 0.82
    dropped.add(2)
    base = words(1000)
    edited = [w if i % 33 else "changed" + str(i) for i, w in enumerate(base)]  # 0.85 on three words at most, below 0.8 on five
    texts += [(3, base), (4, edited)]
    for i in range(100, 400, 2):  # 0.803: close to the limit, where the forest is weakest
        base = words(200)
        texts += [(i, base), (i + 1, base + words(48))]
        dropped.add(i + 1)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert near(1, 2) >= 0.8 > near(3, 4) and all(near(i - 1, i) >= 0.8 for i in dropped)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    left = {r.doc_id for r in pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert left == {i for i, _ in texts} - dropped


def test_stage_on_documents(spark):
    """Every document of the table against the links of a full comparison."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    sets = {}
    for r in docs.collect():
        w = r.text.encode().translate(minhash._LOWER).split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root, changed = {i: i for i in sets}, True
    some = sorted(i for i in sets if sets[i])
    links = [(a, b) for a in some for b in some if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    left = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, DATA).collect())
    assert left == sorted(i for i in sets if root[i] == i)


def test_trees_follow_the_limit():
    assert minhash.trees_for((85, 100)) == 32 and minhash.trees_for((80, 100)) == 64
