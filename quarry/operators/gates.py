"""Loads of items into a versioned table of chunks: a version that fails a gate is never taken over."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.sync import VersionedTable, expectation, replace_items
from quarry.sources.shared import stored


def _references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children without a parent of their item, named children that are not there, ids that stand for a parent and a child."""
    own = parents.select("item", F.col("chunk_id").alias("parent_id"))
    lost = children.join(own, ["item", "parent_id"], "left_anti").select("chunk_id")
    named = parents.select("item", F.explode("child_ids").alias("chunk_id"))
    absent = named.join(children.select("item", "chunk_id"), ["item", "chunk_id"], "left_anti").select("chunk_id")
    both = parents.select("chunk_id").join(children.select("chunk_id"), "chunk_id", "left_semi")
    return lost.unionByName(absent).unionByName(both)


def load(table: VersionedTable, children: DataFrame, parents: DataFrame, items: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces the chunks of the items to load, and returns the gates: name, broken, ok. The version is taken over if all are ok.

    children: item, chunk_id, parent_id and the table's other columns. parents: item, chunk_id, child_ids. items: one row an item,
    with its title where it is to be searched for. find(searched) gets those rows and gives item and found, the items of its best hits.

    children      items to load without a chunk
    count_back    rows that were put in, as the writing job counts them, less those that the new version holds
    references    children and parents that do not name each other, ids that both have
    title_search  items whose title does not find them
    others        other items that do not have as many rows as before
    The last two and the count back take the counts of one pass over the item column of both versions.
    """
    old = table.read()
    put = Observation("put")
    new = children.observe(put, F.count("*").alias("rows"))
    asked = items.select("item").distinct()
    result: list[DataFrame] = []

    def checks(written: DataFrame) -> DataFrame:
        was = old.groupBy("item").agg(F.count("*").alias("was"))
        now = written.groupBy("item").agg(F.count("*").alias("now"))
        both = was.join(now, "item", "full").join(asked.withColumn("loaded", F.lit(True)), "item", "full").fillna(0, ["was", "now"]).fillna(False, ["loaded"])
        tally = stored(both.agg(F.count_if(F.col("loaded") & (F.col("now") == 0)).alias("children"), F.coalesce(F.sum(F.when(F.col("loaded"), F.col("now"))), F.lit(0)).alias("back"), F.count_if(~F.col("loaded") & (F.col("was") != F.col("now"))).alias("others")), "tally")
        searched = items.where("title is not null")
        unfound = searched.join(find(searched).where("found = item"), "item", "left_anti")
        gate = lambda name, n: tally.select(F.lit(name).alias("name"), n.cast("long").alias("broken"), (n == 0).alias("ok"))
        rows = [
            gate("children", F.col("children")),
            gate("count_back", F.abs(F.col("back") - F.lit(put.get["rows"]))),
            expectation("references", _references(children, parents)),
            expectation("title_search", unfound),
            gate("others", F.col("others")),
        ]
        result.append(stored(reduce(DataFrame.unionByName, rows), "gates"))
        return result[0]

    try:
        table.commit(replace_items(old, new, "item"), checks)
    except ValueError:
        if not result:
            raise
    return result[0]
