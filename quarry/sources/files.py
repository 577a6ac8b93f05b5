"""File sources and sinks: JSON lines, CSV, JSON arrays, raw files, archives, chat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, *, tolerant: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped, and with tolerant also lines that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines of a JSON-lines file that do not parse."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    full = StructType([*schema]).add("_bad", "string")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select("value", parsed.alias("p")).where("p._bad is not null").select("value")


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header (a byte order mark is skipped); a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_file(df: DataFrame) -> DataFrame:
    """df with the name, the folder and the time of the file that each row comes from."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return df.withColumn("file", F.col("_metadata.file_name")).withColumn("folder", folder).withColumn("modified", F.col("_metadata.file_modification_time"))


def newest(df: DataFrame, group: Column, name: str = "variant") -> DataFrame:
    """The rows of the newest run of each group. A run is a folder, as Spark writes one result as several files; its time is that of
    its newest file, and of folders as new as each other the last by name counts. df: as from with_file."""
    named = df.withColumn(name, group)
    last = named.groupBy(name).agg(F.max(F.struct("modified", "folder")).alias("m")).select(name, F.col("m.folder").alias("folder"))
    return named.join(last, [name, "folder"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def append_new(df: DataFrame, path: str, key: str, schema: str | StructType) -> int:
    """Appends the rows whose key the sink does not hold yet; returns how many."""
    spark = df.sparkSession
    done = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    fresh = df.join(done.select(key), key, "left_anti")
    n = fresh.count()
    fresh.write.mode("append").json(path)
    return n


def archive(df: DataFrame, ts: str, cutoff: Column, path: str) -> DataFrame:
    """Writes rows before the cutoff to a folder for each month and returns the rest."""
    old = df.where(F.col(ts) < cutoff).withColumn("month", F.date_format(ts, "yyyy-MM"))
    old.write.partitionBy("month").mode("append").json(path)
    return df.where(F.col(ts) >= cutoff)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def chat_line(system: str, user: Column, assistant: Column) -> Column:
    """A training example as JSON: system, user and assistant message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", user), message("assistant", assistant)).alias("messages")))


def read_case_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `line`, which orders the lines of a file as they stand there. Lines that do not parse are rows of nulls."""
    m = F.col("_metadata")
    place = F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.from_json("value", schema).alias("c"), place.alias("line")).select("c.*", "line")


def cases_by_id(tables: list[DataFrame], key: str, line: str | None = None) -> DataFrame:
    """Several case tables as one: the last table that has an id wins, and within a table its last line; rows without an id are left out.

    line: the column that orders the rows of a table, which is not returned. Without it the largest row of an id wins.
    """
    rows = None
    for i, df in enumerate(tables):
        part = df.where(F.col(key).isNotNull()).withColumn("__file", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "__file", line)]
    best = rows.groupBy(key).agg(F.max(F.struct("__file", *([line] if line else []), *rest)).alias("b"))
    return best.select(key, *[F.col("b")[c].alias(c) for c in rest])
