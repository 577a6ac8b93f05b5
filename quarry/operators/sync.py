"""Incremental sync: snapshot diffs, tombstones, idempotent work lists, merges, drift and load gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, print_: str) -> DataFrame:
    """key and outcome (new, changed, restored, unchanged, missing). old also has status."""
    o = old.select(key, F.col(print_).alias("old_print"), "status")
    n = new.select(key, F.col(print_).alias("new_print"))
    outcome = (
        F.when(F.col("old_print").isNull(), "new")
        .when(F.col("new_print").isNull(), "missing")
        .when(F.col("status") != "active", "restored")
        .when(F.col("old_print") != F.col("new_print"), "changed")
        .otherwise("unchanged")
    )
    return o.join(n, key, "full").select(key, outcome.alias("outcome"), "status", "old_print", "new_print")


def strike(ledger: DataFrame, current: DataFrame, key: str, *, strikes: int = 2) -> DataFrame:
    """Active rows of the ledger that the current snapshot lacks get a strike; the last one soft-deletes them."""
    gone = ledger.where(~F.col("status").isin("soft_deleted", "ignored", "purged")).join(current.select(key), key, "left_anti")
    count = F.col("missing_count") + 1
    status = F.when(count >= strikes, "soft_deleted").otherwise("suspect_missing")
    return gone.withColumn("status", status).withColumn("missing_count", count)


def replace_items(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the items in new are replaced by those of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_write(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order. The whole row travels as one struct, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *[F.col("b")[c].alias(c) for c in (*order, *rest)])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Column by column the new value, or the old one where the new one is blank or missing."""
    n = new.select(key, *[F.col(c).alias("n_" + c) for c in old.columns if c != key])
    merged = old.join(n, key, "full")
    return merged.select(key, *[F.coalesce(F.when(F.col("n_" + c).cast("string") != "", F.col("n_" + c)), F.col(c)).alias(c) for c in old.columns if c != key])


def enqueue(jobs: DataFrame, asked: DataFrame, key: list[str], *, revive: bool = False) -> DataFrame:
    """The work list after more jobs were asked for. A job is known by its key columns: one that is there is not added again; with
    revive, those that are completed or failed wait again, with no attempts. jobs: key, status, attempts; asked: key.
    """
    known = asked.select(*key).distinct().withColumn("asked", F.lit(True))
    again = F.coalesce(F.col("asked"), F.lit(False)) & F.col("status").isin("completed", "failed") & F.lit(revive)
    both = jobs.join(known, key, "full")
    status = F.when(F.col("status").isNull() | again, "pending").otherwise(F.col("status"))
    attempts = F.when(F.col("attempts").isNull() | again, 0).otherwise(F.col("attempts"))
    return both.select(*key, status.alias("status"), attempts.cast("int").alias("attempts"))


def delete_by_event(ledger: DataFrame, jobs: DataFrame, events: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The ledger and the work list after delete events (key). Rows of the ledger that are not soft-deleted yet become so, and each
    asks for a job mark_missing with its target, or revives the one it has. Events of unknown rows, and those that come again, do nothing.
    """
    named = events.select(key).distinct()
    hit = ledger.where("status <> 'soft_deleted'").join(named, key, "left_semi")
    marked = ledger.join(named.withColumn("__named", F.lit(True)), key, "left")
    marked = marked.withColumn("status", F.when(F.col("__named"), "soft_deleted").otherwise(F.col("status"))).drop("__named")
    asked = hit.select(key, F.lit("mark_missing").alias("job_type"), F.col(target).alias("target"))
    return marked, enqueue(jobs, asked, [key, "job_type", "target"], revive=True)


def repair(ledger: DataFrame, jobs: DataFrame, drifted: DataFrame, key: str, print_: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, work list, repaired keys) after items were found to have drifted: active rows lose their content hash, so that no
    short cut skips them, and their upsert job is asked for or revived. A row whose hash is empty already waits, and is not repaired again.
    """
    broken = ledger.where((F.col("status") == "active") & (F.col(print_) != "")).join(drifted.select(key), key, "left_semi")
    cleared = ledger.join(broken.select(key, F.lit("").alias("__print")), key, "left")
    cleared = cleared.withColumn(print_, F.coalesce("__print", print_)).drop("__print")
    asked = broken.select(key, F.lit("upsert").alias("job_type"), F.col(target).alias("target"))
    return cleared, enqueue(jobs, asked, [key, "job_type", "target"], revive=True), broken.select(key)


def apply_events(ledger: DataFrame, batch: DataFrame, key: str, route: Column) -> DataFrame:
    """The rows that a batch of events (key, ts, event_id) changes: key, status and the jobs that it asks for.

    A change makes a row active, or new if it is unknown, and asks for upsert. A delete makes one soft-deleted that is not so yet,
    and asks for mark_missing; it does nothing to a row that is unknown when it comes. Events of a key count in order of ts and event_id.
    """
    at = F.struct("ts", "event_id")
    when = batch.groupBy(key).agg(F.min(F.when(route == "change", at)).alias("first"), F.max(F.when(route == "change", at)).alias("last"), F.max(F.when(route == "delete", at)).alias("gone"))
    rows = when.where("last is not null or gone is not null").join(ledger.select(key, "status"), key, "left")
    standing = F.coalesce(F.col("status") != "soft_deleted", F.lit(False))
    deletes = F.col("gone").isNotNull() & (standing | F.coalesce(F.col("first") < F.col("gone"), F.lit(False)))
    ends = deletes & (F.col("last").isNull() | (F.col("gone") > F.col("last")))
    status = F.when(ends, "soft_deleted").when(F.col("last").isNotNull(), "active").otherwise(F.col("status"))
    asked = F.array_compact(F.array(F.when(deletes, "mark_missing"), F.when(F.col("last").isNotNull(), "upsert")))
    return rows.select(key, status.alias("status"), asked.alias("jobs")).where("status is not null")


def reachable(edges: DataFrame, roots: DataFrame, store) -> DataFrame:
    """node and depth of every node that can be reached from the roots, level by level until a level is empty; a node that was
    reached before is not walked again, so loops end. edges: parent, child; roots: node. store(df) writes df and reads it again.
    """
    level = store(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while level.limit(1).count():
        depth += 1
        found = edges.join(level.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        level = store(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level)
    return seen


def drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Items whose number of rows differs between two tables."""
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    a = actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = e.join(a, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected <> actual")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def expectation(name: str, df: DataFrame, bad: Column | None = None) -> DataFrame:
    """One row: name, rows that break the expectation (all rows of df, or those where bad holds), ok."""
    n = F.count("*") if bad is None else F.count_if(bad)
    return df.agg(n.alias("broken")).select(F.lit(name).alias("name"), "broken", (F.col("broken") == 0).alias("ok"))


class VersionedTable:
    """A table kept as path/v=<n>/ folders, each with a marker once it may be read. One writer at a time; readers take the last marker.

    A version is taken over by the creation of its marker file, which a file system does in one step, so a reader sees the old
    version or the new one at any time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int | None:
        fs, p = self._fs(f"{self.path}/taken-*")
        return max((int(x.getPath().getName().split("-")[1]) for x in fs.globStatus(p) or ()), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version() if version is None else version}")

    def commit(self, df: DataFrame, checks: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Writes the next version; readers see it only if every check is ok. checks may be a function of the rows as written."""
        number = (self.version() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        if callable(checks):
            checks = checks(self.read(number))
        if checks is not None and (broken := checks.where("not ok").limit(5).collect()):
            raise ValueError(f"version {number} is not taken over: {[r['name'] for r in broken]}")
        fs, marker = self._fs(f"{self.path}/taken-{number}")
        fs.create(marker, False).close()
        return number
