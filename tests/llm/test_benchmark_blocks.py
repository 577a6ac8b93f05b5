"""Benchmarks of several blocks: the same hits as with one, and no block read before the one before it is searched for."""

from __future__ import annotations

import random

from quarry.llm import decontaminate


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, list(map(tuple, r.spans)), list(r.items)) for r in df.collect())


def test_blocks_by_bytes_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", text(rng.randint(1, 40))) for k in range(40)] + [("null", None), ("long", "x" * 5000 + " " + text(20)), ("twin", None)]
    items.append(("twice", items[3][1]))
    docs = [(i, " ".join([text(5), items[rng.randrange(40)][1], text(9), items[(7 * i) % 40][1]])) for i in range(60)] + [(60, None), (61, ""), (62, items[41][1])]
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)  # rows that come in another order each time
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    whole = rows_of(decontaminate.benchmark_hits(documents, benchmark))
    cut = sorted(map(tuple, decontaminate.decontaminate(documents, benchmark).collect()))
    assert sum(n for _, _, n, _, _ in whole) > 500 and cut != sorted(docs[:60])

    events, real_blocks, real_stored = [], decontaminate._blocks, decontaminate.stored

    def blocks(*how):
        for block in real_blocks(*how):
            events.append("block")
            yield block

    def stored(*how):
        events.append("stored")
        return real_stored(*how)

    monkeypatch.setattr(decontaminate, "_blocks", blocks)
    monkeypatch.setattr(decontaminate, "stored", stored)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert rows_of(decontaminate.benchmark_hits(documents, benchmark)) == whole
    n = events.count("block")
    assert n > 5 and events.count("stored") == n + 1  # the rows and the hits of each block
    assert all(events[:at].count("block") - events[:at].count("stored") <= 2 for at in range(len(events) + 1))
    assert sorted(map(tuple, decontaminate.decontaminate(documents, benchmark).collect())) == cut
