"""What tasks hold at once, and how often vectors are sent, do not follow from the size of the tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.operators import build as B
from quarry.operators import index as I
from quarry.operators import pairs as P


def test_texts_are_cut_by_their_bytes():
    texts = ["a" * n for n in (10, 20, 0, B.SLICE + 5, 1, B.SLICE - 1, 2)] + [None, "é" * (B.SLICE // 2 - 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [p.column(0).to_pylist() for p in B._cut(batch, "text")]
    assert [x for p in parts for x in p] == texts
    assert [len(p) for p in parts] == [3, 1, 2, 3]


def test_chunks_and_parents_do_not_depend_on_slices(spark, monkeypatch):
    text = lambda d: " ".join(f"Sentence {i} of document {d} is here." for i in range(40 * d))
    rows = spark.createDataFrame([(d, i, "text", i // 2, f"s{i // 2}", text(d + i)) for d in range(1, 4) for i in range(4)], "doc_id long, ord int, block_type string, section_no long, section string, text string")

    def found():
        chunks = B.children(rows, "doc_id", "ord")
        return sorted(map(tuple, B.parents(chunks, "doc_id").select("doc_id", "seq", "section_no", "section", "text", "parent_no").collect()))

    whole = found()
    assert len(whole) > 20
    for small in (1, 3000):
        with monkeypatch.context() as m:
            m.setattr(B, "SLICE", small)
            assert found() == whole


def test_vectors_go_to_so_many_tiles_at_most():
    for many in (0, 100, 65_536, 200_000, 615_000, P.TILES * P.LARGEST):
        size = P.tile_of(many)
        assert P.TILE <= size <= P.LARGEST and -(-many // size) <= P.TILES


def test_floats_and_doubles_have_the_same_pairs(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(120, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    pairs = [sorted(map(tuple, P.near_pairs(spark.createDataFrame(rows, f"k long, v array<{kind}>"), "k", "v", 0.4, tile=32).collect())) for kind in ("float", "double")]
    assert pairs[0] == pairs[1] and pairs[0]


def test_a_full_block_of_queries_holds_few_numbers_at_once():
    """A chunk of scores, its copies in the best list, and the meetings with their places and weights: doubles of a task."""
    assert 8 * (4 * I.CHUNK + 10 * I.MEETINGS) <= 64 << 20


def test_a_batch_of_the_index_is_let_go_before_the_next_one():
    held, floor = [], pa.total_allocated_bytes()

    def batch(at: int) -> pa.RecordBatch:
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(range(0, 100_001, 100), pa.int32()), pa.array(values, kind))
        terms = lists([f"w{i % 100}" for i in range(100_000)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(range(at, at + 1000)), pa.array([100] * 1000), terms, lists([1] * 100_000, pa.int64())], names=["key", "dl", "terms", "tfs"])

    def batches():
        for i in range(4):
            held.append(pa.total_allocated_bytes() - floor)
            yield batch(1000 * i)

    words = np.array([0, 1]), np.array([0, 1]), np.array([1.0, 2.0])
    hits = I._meet(batches(), pa.array([7, 8]), ["w3", "w5"], words, 2, 100.0, 300, 500)
    keys = set()
    for out in hits:
        keys.update(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
        del out
    assert {7, 8} == {q for q, _ in keys} and max(held) < 500_000
