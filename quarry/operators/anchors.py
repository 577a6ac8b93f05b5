"""Windows that begin at the first request after the last one, for keys of any size: range search and pointer doubling.

From every request the first one at or after the end of a window that would start there is known by ranks alone: requests and window
ends are put in one order, and the number of requests before an end is the rank of the last request inside. These jumps are doubled
round by round, while the set of true starts (the first request, and whatever the jumps reach from a start) doubles too. Rounds
are as many as the binary logarithm of the most windows of a key, and each is two joins by key and rank, so no key has to fit a
task. Places within windows are running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranks import running
from quarry.sources.shared import stored


def window_starts(ranked: DataFrame, jumps: DataFrame) -> DataFrame:
    """key, nth of the requests at which windows start. ranked: key, nth (from 1); jumps: key, nth, to (later than nth)."""
    starts = stored(ranked.where("nth = 1").select("key", "nth"), "starts")
    jumps = stored(jumps.select("key", "nth", "to"), "jumps")
    while jumps.limit(1).count():
        reached = starts.join(jumps, ["key", "nth"]).select("key", F.col("to").alias("nth"))
        starts = stored(starts.unionByName(reached).distinct(), "starts")
        onward = jumps.select("key", F.col("nth").alias("to"), F.col("to").alias("further"))
        jumps = stored(jumps.join(onward, ["key", "to"]).select("key", "nth", F.col("further").alias("to")), "jumps")
    return starts


def spread_windows(events: DataFrame, key: str, us: str, order: str, *, seconds: int, limit: int) -> DataFrame:
    """key, order, window_start, nth and over of every event: what a fold over each key's sorted events gives.

    events: key, us (microseconds), order (settles equal times). A null key is a key; null times are left out.
    """
    rows = events.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(us).cast("long").alias("us"), F.col(order).alias("o")).where("us is not null")
    request = rows.select("key", "us", F.lit(1).cast("long").alias("is_request"), "o")
    ends = rows.select("key", (F.col("us") + seconds * 1_000_000).alias("us"), F.lit(0).cast("long").alias("is_request"), "o")
    # an end stands before a request of the same time, which is no longer inside
    both = running(request.unionByName(ends), ["key"], [F.col("us").asc(), F.col("is_request").asc(), F.col("o").asc()], rank="_", sums={"seen": "is_request"})
    both = stored(both.select("key", "us", "o", "is_request", "seen"), "requests")
    ranked = both.where("is_request = 1").select("key", "us", "o", F.col("seen").alias("nth"))
    following = both.where("is_request = 0").select("key", F.col("us").alias("end"), "o", (F.col("seen") + 1).alias("to"))
    counts = ranked.groupBy("key").agg(F.count("*").alias("n"))
    jumps = ranked.withColumn("end", F.col("us") + seconds * 1_000_000).join(following, ["key", "end", "o"]).distinct()
    jumps = jumps.join(counts, "key").where(F.col("to") <= F.col("n")).select("key", "nth", "to").distinct()
    starts = window_starts(ranked, jumps).withColumn("is_start", F.lit(1).cast("long"))
    marked = ranked.join(starts, ["key", "nth"], "left").withColumn("is_start", F.coalesce("is_start", F.lit(0)).cast("long"))
    numbered = running(marked, ["key"], [F.col("nth").asc()], rank="_", sums={"window": "is_start"})
    numbered = numbered.withColumn("first_us", F.when(F.col("is_start") == 1, F.col("us")).otherwise(0)).select("key", "window", "us", "o", "nth", "first_us")
    placed = running(numbered, ["key", "window"], [F.col("nth").asc()], rank="place", sums={"window_start": "first_us"})
    return placed.select(F.col("key.k").alias(key), F.col("o").alias(order), "window_start", F.col("place").alias("nth"), (F.col("place") > limit).alias("over"))
