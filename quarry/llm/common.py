"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate and substring contracts: anything but ASCII white space.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context's checkpoint folder.

    On a cluster one of them has to be set. In a local session, whose tasks see the driver's folders, a temporary one will do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return context.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders that this process has written to the shared folder, in order, and the catalog's tables over them.
WRITTEN: list[str] = []
TABLES: dict[str, str] = {}


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders written by stored() or pack() that no later job reads, and the tables over them."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS `{TABLES.pop(path)}`") if path in TABLES else None
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names: id (long) and body (UTF-8 bytes, null stays null)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds about `limit` bytes of `column`, or one row if that row is longer."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
