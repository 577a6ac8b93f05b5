"""A keyed table that micro-batches change: each batch writes the rows it changes, not the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changes:
    """path/delta-<batch> holds the rows that a batch has changed, path/full-<batch> in their place the table as of that batch.

    Every `every`-th batch writes a full table, so a reader takes at most `every` folders. A batch reads what is before it and
    overwrites its own folder, so one that comes again after a failure leaves what it left before: exactly once.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, *, every: int = 16):
        self.spark, self.path, self.key, self.schema, self.every = spark, path.rstrip("/"), key, schema, every

    def _folders(self, before: int | None) -> list[tuple[int, str]]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = base.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(base) or ()
        names = [x.getPath().getParent().getName() for x in found]
        parts = sorted((int(name.split("-")[1]), name) for name in names if before is None or int(name.split("-")[1]) < before)
        full = max((i for i, name in parts if name.startswith("full")), default=-1)
        return [(i, name) for i, name in parts if i > full or (i == full and name.startswith("full"))]

    def read(self, before: int | None = None) -> DataFrame:
        """The table as it was before a batch, or as it is. The row of a key's last batch counts."""
        rest = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in self.key]
        folders = [f"{self.path}/{name}" for _, name in self._folders(before)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema + ", __batch long").parquet(*folders)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
        return last.select(*self.key, *[F.col("r")[c].alias(c) for c in rest])

    def write(self, batch: int, changed: DataFrame) -> None:
        """changed: whole rows, one a key."""
        full = batch % self.every == self.every - 1
        if full:
            old = self.read(batch).join(changed.select(*self.key), self.key, "left_anti")
            changed = old.unionByName(changed)
        name = f"{'full' if full else 'delta'}-{batch}"
        changed.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{name}")
