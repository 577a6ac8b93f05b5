"""Registration of queries: a callable (spark, sf_dir) -> DataFrame and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What queries of one session share (indexes of a table), by session, table and the table's state.
SHARED: dict[tuple, object] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder: t.documents, t.events, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def shared(t: Tables, name: str, tables: list[str], build: Callable[[], object]):
    """What build() makes of tables, made once a session as long as the tables' files are the same ones."""
    stamps = []
    for table in tables:
        path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{table}.parquet")
        fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
        files = fs.listStatus(path)
        stamps += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    key = (t.spark.sparkContext.applicationId, name, *stamps)
    if key not in SHARED:
        SHARED[key] = build()
    return SHARED[key]


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under `name`."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def anchored_sql(rows: str, seconds: int) -> str:
    """SQL of windows anchored at a key's first request after its last window: CTEs that end in `w` (k, event_id, us, start).

    rows: a relation with k, event_id and us. The first window starts at a key's first row; the others follow from pointers to the
    first row at or after a window's end.
    """
    return f"""RECURSIVE e AS ({rows}), p AS (SELECT DISTINCT k, us FROM e),
nx AS (SELECT k, us, min(us) OVER (PARTITION BY k ORDER BY us RANGE BETWEEN {seconds * 1_000_000} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p),
a AS (SELECT k, min(us) AS us FROM p GROUP BY k UNION SELECT nx.k, nx.nxt FROM a JOIN nx ON nx.k = a.k AND nx.us = a.us WHERE nx.nxt IS NOT NULL),
w AS (SELECT e.*, max(a.us) OVER (PARTITION BY e.k ORDER BY e.us) AS start FROM e LEFT JOIN a ON e.k = a.k AND e.us = a.us)"""
