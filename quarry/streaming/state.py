"""Keyed state in streams: stale threads and anchored windows by event-time timers, numbers that go on over micro-batches and runs.

State lives in the state store under the query's checkpoint folder, so a restarted query goes on where it stopped. Timers drop what no
later row can need: rows behind the watermark do not come, so a thread or window that the watermark has passed is done.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.events import LATE, run_to_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession):
    """Within it, new stream queries keep their state in the store that has timers and maps."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


#: Keys are dealt into so many groups; a group's keys share one state row and one timer, and their rows are worked on together. A call
#: of a processor costs milliseconds whatever it is given, so there is one for a group and not one for each of its keys.
GROUPS = 512


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """rows with the group of their key, and the key as text, so that any type of key can stand in a state's lists."""
    return rows.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).withColumn(key, F.col(key).cast("string"))


class Grouped(StatefulProcessor):
    """State of all keys of a group, and one timer for the one that is due first. Subclasses name the state and say when a key is due."""

    name: str
    key: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(self.name, "timer long, keys array<string>, times array<long>, counts array<long>")

    def due(self, time: int) -> int:
        raise NotImplementedError

    def load(self) -> tuple[int | None, dict[str | None, tuple[int, int]]]:
        """The timer that is set, and time and count of every key."""
        if not self.state.exists():
            return None, {}
        timer, keys, times, counts = self.state.get()
        return timer, dict(zip(keys, zip(times, counts)))

    def save(self, timer: int | None, known: dict[str | None, tuple[int, int]]) -> None:
        """timer: the one that is still set, if any."""
        if not known:
            self.state.clear()
            return
        first = self.due(min(time for time, _ in known.values()))
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        times, counts = zip(*known.values())
        self.state.update((first, list(known), list(times), list(counts)))

    def close(self) -> None:
        pass


def keyed(rows: Iterator[pd.DataFrame], key: str, *columns: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys, each row's place among them, and the rows' columns."""
    parts = [(pdf[key].to_numpy(dtype=object), *[pdf[c].to_numpy() for c in columns]) for pdf in rows]
    keys, *rest = (np.concatenate(x) for x in zip(*parts))
    code, names = pd.factorize(keys, use_na_sentinel=False)
    return np.where(pd.isna(names), None, names), code, rest


class StaleThreads(Grouped):
    """A thread is stale once `gap` milliseconds of event time have passed since its last row. Its rows are counted till then."""

    name = "seen"

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, known = self.load()
        names, code, (us,) = keyed(rows, self.key, "us")
        order = np.lexsort((us, code))
        code, us = code[order], us[order]
        start = np.searchsorted(code, np.arange(len(names) + 1))
        first, end = start[:-1], start[1:]
        before = [known.get(name) for name in names]
        last = np.array([int(us[at]) if b is None else b[0] for at, b in zip(first, before)])
        n = np.array([0 if b is None else b[1] for b in before])
        previous = np.r_[us[:1], us[:-1]]
        previous[first] = last
        previous = np.maximum(previous, last[code])
        breaks = np.flatnonzero(us - previous >= self.gap * 1000)  # rows that come after a gap, in this micro-batch
        owner = code[breaks]
        upto = n[owner] + breaks - first[owner]  # rows of the thread before the gap, those that an earlier gap ended included
        same = np.r_[False, owner[1:] == owner[:-1]][: len(owner)]
        counts = upto - np.where(same, np.r_[0, upto[:-1]][: len(upto)], 0)
        ended = np.zeros(len(names), np.int64)
        ended[owner] = upto  # the last one of a thread stays
        n, last = n + end - first - ended, np.maximum(last, us[end - 1])
        known.update(zip(names.tolist(), zip(last.tolist(), n.tolist())))
        self.save(timer, known)
        if len(breaks):
            yield pd.DataFrame({self.key: names[owner], "last_us": previous[breaks], "rows": counts})

    def due(self, time: int) -> int:
        return -(-time // 1000) + self.gap

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (_, known) = timerValues.getCurrentWatermarkInMs(), self.load()
        stale = {name: x for name, x in known.items() if self.due(x[0]) <= now}
        self.save(None, {name: x for name, x in known.items() if name not in stale})
        if stale:
            last, n = zip(*stale.values())
            yield pd.DataFrame({self.key: list(stale), "last_us": last, "rows": n})


def stale_threads(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """key, last_us, rows of every thread, at the time when it has had no row for gap_ms. A thread that goes on later starts anew."""
    rows = grouped(events.withWatermark(ts, LATE).select(key, ts, F.unix_micros(ts).alias("us")), key)
    found = rows.groupBy("__group").transformWithStateInPandas(StaleThreads(key, gap_ms), f"`{key}` string, last_us long, rows long", "append", "eventTime")
    return found.withColumn(key, F.col(key).cast(events.schema[key].dataType))


class Anchored(Grouped):
    """Windows anchored at a key's first request after the last window; a window's start and count go when the watermark passes its end."""

    name = "window"

    def __init__(self, key: str, seconds: int, limit: int):
        self.key, self.micros, self.limit = key, seconds * 1_000_000, limit

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, known = self.load()
        names, code, (us, ids) = keyed(rows, self.key, "us", "event_id")
        order = np.lexsort((ids, us, code))
        code, us, ids = code[order], us[order], ids[order]
        upto = np.searchsorted(code, np.arange(len(names) + 1)).tolist()
        begins, starts, before = [], [], []  # of each run of rows in one window: its first row, the window's start, its rows of earlier micro-batches
        for name, at, end in zip(names.tolist(), upto, upto[1:]):
            start, n = known.get(name, (None, 0))
            while at < end:  # one step a window
                if start is None or us[at] - start >= self.micros:
                    start, n = int(us[at]), 0
                begins.append(at)
                starts.append(start)
                before.append(n)
                to = bisect_left(us, start + self.micros, at, end)
                n, at = n + to - at, to
            known[name] = start, n
        many = np.diff(np.r_[begins, len(us)])
        nth = np.arange(1, len(us) + 1) - np.repeat(np.array(begins) - before, many)
        self.save(timer, known)
        yield pd.DataFrame({self.key: names[code], "event_id": ids, "window_start": np.repeat(starts, many), "nth": nth, "over": nth > self.limit})

    def due(self, time: int) -> int:
        return -(-(time + self.micros) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (_, known) = timerValues.getCurrentWatermarkInMs(), self.load()
        self.save(None, {name: x for name, x in known.items() if self.due(x[0]) > now})
        return iter([])


def anchored(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """key, event_id, window_start, nth, over of every event: the stream twin of the batch fold.

    A key's micro-batches have to come in order of time; within one the rows of a group of keys are put in order (16 bytes a row and the
    keys), so their size is bounded by the source's rate.
    """
    rows = grouped(events.withWatermark(ts, LATE).select(key, "event_id", ts, F.unix_micros(ts).alias("us")), key)
    schema = f"`{key}` string, event_id long, window_start long, nth long, over boolean"
    found = rows.groupBy("__group").transformWithStateInPandas(Anchored(key, seconds, limit), schema, "append", "eventTime")
    return found.withColumn(key, F.col(key).cast(events.schema[key].dataType))


def answered_before(requests: DataFrame, key: str, ts: str, ttl: int) -> DataFrame:
    """key, event_id, written_us, hit of every request: a hit is one within ttl seconds of the request whose result was kept.

    A hit does not renew a result, so its time runs from the request that made it: a window anchored there, of which all requests
    but the first are hits. A result's state goes when the watermark passes its end, and ties are in order of event_id.
    """
    return anchored(requests, key, ts, ttl, 1).select(key, "event_id", F.col("window_start").alias("written_us"), F.col("over").alias("hit"))


#: Parts of a group's list before they are written as one, and rows that are folded at once.
PARTS, FOLDED = 16, 1 << 20
#: Stands for an ord that is null: it comes last.
NO_ORD = (1 << 63) - 1


class Numbers(StatefulProcessor):
    """The sources of a thread, numbered without gaps in the order in which they come, for all threads of a group.

    The state is a list of Arrow tables, one a micro-batch: the sources that it brought. As numbers have no gaps, a thread's last one is
    their count.
    """

    def __init__(self, parts: int):
        self.parts = parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "part binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(part).read_all() for (part,) in self.known.get()] if self.known.exists() else []
        new, last = first_uses(rows), {}
        if parts:
            known = pa.concat_tables(parts)
            new = new.join(known, ["thread", "source"], join_type="left anti", use_threads=False)
            counts = known.group_by("thread", use_threads=False).aggregate([("source", "count")])
            last = dict(zip(counts["thread"].to_pylist(), counts["source_count"].to_pylist()))
        if not new.num_rows:
            return
        new = new.sort_by([("thread", "ascending"), ("first", "ascending"), ("source", "ascending")])
        thread = new["thread"].combine_chunks().dictionary_encode()
        code = thread.indices.to_numpy()
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        before = np.array([last.get(name, 0) for name in thread.dictionary.to_pylist()])
        number = before[code] + np.arange(1, len(code) + 1) - np.repeat(start, np.diff(np.r_[start, len(code)]))
        added = new.select(["thread", "source"])
        if len(parts) < self.parts:
            self.known.appendValue((packed(added),))
        else:
            self.known.put([(packed(pa.concat_tables([*parts, added])),)])
        out = new.select(["thread", "source", "first"]).append_column("number", pa.array(number))
        yield from (pa.Table.from_batches([b]).to_pandas() for b in out.to_batches(max_chunksize=FOLDED))

    def close(self) -> None:
        pass


def packed(table: pa.Table) -> bytes:
    """The table as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def first_uses(rows: Iterator[pd.DataFrame]) -> pa.Table:
    """thread, source, first: the least ord of each source of a thread. rows: thread, ord, source."""
    kind = pa.schema([("thread", pa.string()), ("source", pa.string()), ("first", pa.int64())])

    def folded(tables: list[pa.Table]) -> pa.Table:
        least = pa.concat_tables(tables).group_by(["thread", "source"], use_threads=False).aggregate([("first", "min")])
        return least.rename_columns({"first_min": "first"}).select(kind.names).cast(kind)

    held, many = [kind.empty_table()], 0
    for pdf in rows:
        columns = [pa.array(pdf["thread"], pa.string()), pa.array(pdf["source"], pa.string()), pa.array(pdf["ord"], pa.int64())]
        held.append(pa.Table.from_arrays(columns, schema=kind))
        many += len(pdf)
        if many > FOLDED:
            held, many = [folded(held)], 0
    return folded(held)


def citation_numbers(uses: DataFrame) -> DataFrame:
    """uses: thread, ord, source. The stream twin of the batch numbering: each source of a thread once, with its number, when it first
    comes. Turns of a thread have to come in order; within a micro-batch they are put in order, those without ord last.

    A micro-batch reads the sources so far of the groups that it touches, and writes the new ones. Null sources are none.
    """
    kind = uses.schema["thread"].dataType
    ord_ = F.coalesce(F.col("ord").cast("long"), F.lit(NO_ORD))
    rows = grouped(uses.where("source is not null").select("thread", ord_.alias("ord"), "source"), "thread")
    named = F.coalesce(F.concat(F.lit("="), "thread"), F.lit(""))  # Arrow's joins do not match nulls
    rows = rows.withColumn("thread", named)
    found = rows.groupBy("__group").transformWithStateInPandas(Numbers(PARTS), "thread string, source string, first long, number long", "append", "none")
    thread = F.when(F.col("thread") != "", F.substring("thread", 2, NO_ORD >> 32)).cast(kind)
    return found.select(thread.alias("thread"), "source", F.nullif("first", F.lit(NO_ORD)).alias("first"), "number")


def run_with_state(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream with timers or maps over what there is now, into Parquet, and reads the result of all runs so far."""
    with timed_state(stream.sparkSession):
        return run_to_table(stream, path, checkpoint)
