"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WRITTEN, discard, stored

#: Keys with more rows than others, at most: their side of a join is broadcast, so their rows stay where they are.
HOT_KEYS = 10_000
HOT_ROWS = 100


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to per_key, which has one row a key and the key's number of rows in `size`; the sizes add up to total at most.

    Keys with more than a HOT_KEYS-th of all rows are at most HOT_KEYS, so they are broadcast; all others meet by a shuffle,
    where no task gets more than that of one key.
    """
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    frequent = per_key.where(F.col(size) > limit).drop(size).collect()  # HOT_KEYS rows at most
    if not frequent:
        return rows.join(per_key.drop(size).hint("shuffle_hash"), key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(frequent, per_key.drop(size).schema))
    rest = rows.join(hot.select(key), key, "left_anti").join(per_key.drop(size).hint("shuffle_hash"), key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. The smallest node reachable from every node: id, root.

    Alternates large and small stars: each node hangs its larger (then its smaller) neighbours under the smallest one it sees.
    Every round is two aggregations of minima, which combine before the shuffle, and two joins, in which a node with very many
    neighbours is broadcast. Rounds are written out, and end when nothing changes; the files of a round go when the next one is
    written. Null ends make no edge, loops and repeated edges add nothing, and an empty table has no components.
    """
    spark, before, written = edges.sparkSession, None, len(WRITTEN)
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total = pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
        large = stored(spread_join(pairs, least, "v", "n", 2 * total).select("u", F.col("m").alias("v")), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "pairs")
        discard(spark, WRITTEN[written:-1])
        *state, total = pairs.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")).first()
        if (state, total) == before:
            roots = pairs.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
        before = state, total
