"""The fit holds places of weights, and a batch of rows as a matrix."""

from __future__ import annotations

import tracemalloc

import numpy as np

from quarry.llm import quality


def test_fit_holds_no_matrix_of_all_rows():
    rng = np.random.default_rng(3)

    def rows(n, shift):
        counts = np.full(n, 20)
        return quality.Rows(rng.standard_normal((n, quality.FEATURES)) + shift, rng.integers(0, quality.BUCKETS, 20 * n).astype("<u2"), counts)

    positive, mixed = rows(6_000, 0.0), rows(24_000, 0.3)
    tracemalloc.start()
    model = quality.fit(positive, mixed, prior=0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.score(positive)) == 6_000
    assert peak < 90 << 20  # a matrix of both samples alone has 104 MB


def test_rows_of_a_matrix_are_those_asked_for():
    found = quality.Rows(np.arange(66.0).reshape(3, quality.FEATURES), np.array([5, 7, 7, 9], "<u2"), np.array([2, 0, 2]))
    edges = np.tile(np.linspace(10, 60, quality.BINS - 1), (quality.FEATURES, 1))
    whole = quality.design(edges, found)
    at = quality.BINS * quality.FEATURES
    matrix = whole.of(np.array([2, 1, 0, 2]))
    assert np.flatnonzero(matrix[0, at:-1]).tolist() == [7, 9] and np.flatnonzero(matrix[2, at:-1]).tolist() == [5, 7]
    assert not matrix[1, at:-1].any() and (matrix[:, -1] == 1).all() and (matrix[:, :at].sum(axis=1) == quality.FEATURES).all()
    w = np.arange(at + quality.BUCKETS + 1, dtype=np.float32)
    assert np.allclose(whole.outputs(w, np.arange(3)), whole.of(np.arange(3)) @ w)
