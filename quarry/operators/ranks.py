"""Ranks and running sums within groups of any size: no group has to fit a task, and none is sorted in one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import stored


def _name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running(
    df: DataFrame, keys: list[str], order: list[Column], *, rank: str = "rank", sums: Mapping[str, str] | None = None, keep: list[str | Column] | None = None, unique: str | None = None
) -> DataFrame:
    """The rows of df (or their columns in `keep`), each with its rank (from 1) within its keys, and running sums of columns.

    sums: name of a new column -> the column that it sums, this row included; unique: name of a column that gets a number of the
    row which follows the order of all rows, with gaps. Without keys all rows are one group.

    Rows are dealt out by ranges of keys and order, so that a frequent key is spread over tasks; each task numbers its part. What
    stands in earlier parts is known from one row a part for each key that is the first or last one of any part. These rows, three
    times the number of parts at most, are broadcast.

    Equal rows share no rank: one comes first. Null keys are a key of their own; the order says where nulls go. An empty table
    has no rows.
    """
    sums = dict(sums or {})
    at, part, before = (_name(df, n) for n in ("__at", "__part", "__before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(k).asc_nulls_first() for k in keys] + order
    dealt = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn(at, F.monotonically_increasing_id())
    shown = list(df.columns)
    if keep is not None:
        shown = dealt.select(*keep).columns
        dealt = dealt.select(*keep, *[c for c in dict.fromkeys([*keys, *sums.values()]) if c not in shown], at)
    dealt = stored(dealt, "ranks").withColumn(part, F.shiftrightunsigned(at, 33))
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    few = dealt.select(group.alias("k"), F.col(part).alias("p"), F.col(at).alias("at"), F.lit(1).cast("long").alias("v0"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(sums.values(), 1)])
    values = [f"v{i}" for i in range(len(sums) + 1)]
    ends = few.groupBy("p").agg(F.min("at").alias("first"), F.max("at").alias("last")).select(F.explode(F.array("first", "last")).alias("at"))
    reaching = few.join(F.broadcast(ends), "at", "left_semi").select("k").distinct()
    counted = few.join(F.broadcast(reaching), "k", "left_semi").groupBy("k", "p").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("k", "p", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values]).where("v0 > 0")
    within = Window.partitionBy(part, *keys).orderBy(at)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({rank: F.row_number().over(within).cast("long")} | {name: F.sum(c).over(so_far) for name, c in sums.items()})
    k, p = _name(out, "__k"), _name(out, "__p")
    counted = counted.select(F.col("k").alias(k), F.col("p").alias(p), F.struct(*values).alias(before))
    out = out.join(F.broadcast(counted), (F.col(part) == F.col(p)) & group.eqNullSafe(F.col(k)), "left")
    add = lambda name, v: F.col(name) + F.coalesce(F.col(before)[v], F.lit(0))
    out = out.withColumns({rank: add(rank, "v0")} | {name: add(name, f"v{i}") for i, name in enumerate(sums, 1)})
    if unique:
        out = out.withColumnRenamed(at, unique)
    return out.select(*[c for c in shown if c not in (rank, unique)], *([unique] if unique else []), rank, *sums)
