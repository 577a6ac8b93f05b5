"""Request keys and results that are used again within a time limit."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from test_stream_state import START, feed, states

from quarry.operators import retrieve as R
from quarry.streaming import state as S


def plain_key(text, item, least, top_k, revision, reference):
    parts = [" ".join((text or "").split()), item or "", "" if least is None else f"{least:.4f}", str(top_k or ""), str(revision), "" if reference is None else str(reference)]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def test_keys_take_every_part_and_fold_white_space(spark):
    texts = [None, "", "  a \t b　c \x85d\x1ce ", "a b c d e", "A b", "a b?", " x \x0b\x0cy\r\n"]
    rows = [(t, "1", 0.35, 5, 3, True) for t in texts]
    rows += [("a", None, 0.35, 5, 3, True), ("a", "1", None, 5, 3, True), ("a", "1", 0.2, 5, 3, True), ("a", "1", 0.35, 0, 3, True), ("a", "1", 0.35, None, 3, True)]
    rows += [("a", "1", 0.35, 5, 4, True), ("a", "1", 0.35, 5, 3, False), ("a", "1", 0.35, 5, 3, None), ("a", "1", 0.35001, 5, 3, True), ("a", "1", 0.35, 5, 3, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, item string, least double, k int, rev int, ref boolean")
    keys = R.request_key(*[F.col(c) for c in ("t", "item", "least", "k", "rev", "ref")])
    got = [r.key for r in df.select("i", keys.alias("key")).orderBy("i").collect()]
    assert got == [plain_key(*r) for r in rows]
    assert got[2] == got[3] and got[0] == got[1] and got[-2] == got[-1] and len(set(got)) == len(rows) - 4


@pytest.mark.parametrize("slices", [1, 3])
def test_a_hit_does_not_renew_a_result(spark, tmp_path, slices):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [[("a", 1, at(0)), ("b", 2, at(5)), ("a", 3, at(59))], [("a", 4, at(60)), ("a", 5, at(60)), ("b", 6, at(64))], [("a", 7, at(119)), ("a", 8, at(120)), ("b", 9, at(600))]]
    stream = feed(spark, tmp_path, rows, "k string, event_id long, ts timestamp", slices)
    out = S.run_with_state(S.answered_before(stream, "k", "ts", 3600), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {r.event_id: r.hit for r in out.collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True, 8: False, 9: False}
    assert states(spark, f"{tmp_path}/state", "window") == 1  # only the newest result can still be used
