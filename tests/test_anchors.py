"""Windows by doubled jumps against the fold, with a key that holds most requests and equal times."""

from __future__ import annotations

import datetime as dt
import random

from quarry.operators.logs import anchored_windows


def test_hot_keys_equal_the_fold(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(900):
        at += rng.choice([0, 0, 0.5, 7, 30, 59, 60, 300])
        rows.append((1 if rng.random() < 0.8 else rng.randrange(2, 5), i, start + dt.timedelta(seconds=at)))
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").repartition(5)
    windows = lambda folded: sorted(map(tuple, anchored_windows(events, "user_id", "ts", "event_id", seconds=60, limit=3, folded=folded).select("user_id", "event_id", "window_start", "nth", "over").collect()))
    fold = windows(10_000)
    assert len(fold) == 900 and windows(100) == fold  # one key is spread
    assert windows(0) == fold  # all keys are
