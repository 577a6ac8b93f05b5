"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Targets come from weights by filling up: every source gets its weighted share, none more than `most` times its own words, and what
is over goes to the others by weight. The mix is a row of slots of about `block` words. Slot t has the point frac(t x golden ratio);
the points fall through the cumulated targets of the sources, so that every stretch of slots holds each source close to its share.
The slots of a source are ranked. Its documents, shuffled by a hash and laid end to end (`most` times over), are cut into as many
equal blocks as it has slots, and slot and block of one rank are joined. So each source gives its target, rounded to a word, and a
document is read at most `most` times.

All of it is DataFrame operations. Ranks and running sums go by ranges (quarry.operators.ranks), so a source may hold any share of
the rows; slots and pieces of documents meet by source and rank, a frequent source meets its documents by a broadcast of one row.

Defined results: a null or empty text has no words, stands in the result and is in no slot; a null source is a source, the last
one; null ids and repeated rows are rows of their own (rows of one id and size are interchangeable); a text of any length is cut
into as many pieces as it has blocks; a table without words has the target 0 everywhere, an empty one no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table
from quarry.llm.graph import spread_join
from quarry.operators.ranks import running

WEIGHTS = (3, 1, 2)
#: Words of a slot, about. Sources have whole numbers of slots, and at least one if they have a target.
BLOCK = 4096
#: Points are whole numbers below 2 ** POINT_BITS; GOLDEN is the golden ratio's fraction in these units.
POINT_BITS, HALF = 62, (1 << 31) - 1
GOLDEN = (math.isqrt(5 << 2 * POINT_BITS) - (1 << POINT_BITS)) // 2


def words(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def point(t: Column) -> Column:
    """t x GOLDEN modulo 2 ** POINT_BITS, by halves of 31 bits, so that no product overflows. t is below 2 ** 62."""
    t0, t1 = t.bitwiseAND(HALF), F.shiftright(t, 31)
    g0, g1 = GOLDEN & HALF, GOLDEN >> 31
    middle = (t0 * g1 + t1 * g0).bitwiseAND(HALF)
    return (t0 * g0 + F.shiftleft(middle, 31)).bitwiseAND((1 << POINT_BITS) - 1)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _div(a: Column, n: Column, d: Column, up: bool = False) -> Column:
    """a x n / d in whole numbers, without overflow of the product."""
    product = _wide(a) * _wide(n) + (_wide(d) - 1 if up else F.lit(0))
    return F.call_function("div", product, _wide(d))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sources: s, size. Adds place (order of s, the empty one last), weight, target (double) and words (the target in whole words).

    All targets together are share[0] / share[1] of all sizes, no target is above most x its size. Filling up ends at a level per
    weight; a source is full if its cap per weight is not above what the ones that are full before it leave to the rest.
    """
    by = F.array(*map(F.lit, weights))
    placed = running(sources, [], [(F.col("s") == "").asc(), F.col("s").asc()], rank="place")
    weight = F.element_at(by, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = placed.withColumns({"weight": weight, "cap": F.col("size") * most})
    size, all_weights = (int(x or 0) for x in rows.agg(F.sum("size"), F.sum("weight")).first())
    multiple = math.lcm(*weights)
    rows = running(rows, [], [(_wide(F.col("cap")) * (F.lit(multiple) / F.col("weight")).cast("long")).asc(), F.col("place").asc()], rank="n", sums={"caps": "cap", "weighed": "weight"})
    left_weight = F.lit(all_weights) - F.col("weighed") + F.col("weight")
    left_words = F.lit(share[0] * size) - share[1] * (F.col("caps") - F.col("cap"))
    rows = rows.withColumn("full", _wide(F.col("cap") * share[1]) * _wide(left_weight) <= _wide(F.col("weight")) * _wide(left_words))
    rows = stored(rows.drop("n", "caps", "weighed"), "targets")
    full, full_weight = (int(x or 0) for x in rows.where("full").agg(F.sum("cap"), F.sum("weight")).first())
    rest = F.lit(share[0] * size / share[1] - full) * F.col("weight") / F.lit(float(max(1, all_weights - full_weight)))
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest))
    return rows.withColumn("words", F.floor(F.col("target") + 0.5)).drop("full", "cap")


@dataclass
class Mix:
    """rows: row, id, size, source_size, target of every document. pieces: slot, row, id, first (word of the document), length."""

    rows: DataFrame
    pieces: DataFrame


def slots(sources: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(slots, counts). slots: t, i, k: the time of the k-th slot of source i. counts: s, i, n: slots of each source with words.

    Sources and points are put in one order; the number of sources up to a point is the source that it falls to.
    """
    spark = sources.sparkSession
    upto = running(sources.where("words > 0"), [], [F.col("place").asc()], rank="i", sums={"upto": "words"})
    upto = stored(upto.select("s", "i", "words", "upto"), "upto")
    total = int(upto.agg(F.sum("words")).first()[0] or 0)
    number = -(-total // block)
    lower = _div(F.col("upto") - F.col("words"), F.lit(1 << POINT_BITS), F.lit(max(1, total)))
    starts = upto.select(lower.alias("u"), F.lit(1).cast("long").alias("mark"), F.col("i").alias("t"))
    points = spark.range(number).select(point(F.col("id")).alias("u"), F.lit(0).cast("long").alias("mark"), F.col("id").alias("t"))
    fallen = running(starts.unionByName(points), [], [F.col("u").asc(), F.col("mark").desc(), F.col("t").asc()], rank="_", sums={"i": "mark"})
    ranked = running(fallen.where("mark = 0").select("i", "t"), ["i"], [F.col("t").asc()], rank="k")
    counts = upto.join(ranked.groupBy("i").agg(F.count("*").alias("n")), "i", "left").select("s", "i", "n")
    missed = counts.where("n is null").select("i", (F.lit(number) + F.col("i")).alias("t"), F.lit(1).cast("long").alias("k"))
    return ranked.unionByName(missed), counts.na.fill(1, ["n"])


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, block: int = BLOCK, seed: str = "mix"
) -> Mix:
    """The schedule of the mix and the sizes and targets behind it. Runs of one seed are equal."""
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    docs = stored(docs.select(F.col(id_col).alias("id"), source.alias("s"), words(F.col(text_col)).alias("size")), "sizes")  # texts are read once
    shuffled = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = running(docs, ["s"], [shuffled.asc(), F.col("id").asc_nulls_first(), F.col("size").asc()], rank="nth", sums={"upto": "size"}, unique="row")
    per = stored(rows.groupBy("s").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), "sources")
    goal = stored(targets(per, weights, share, most).withColumnRenamed("size", "source_size"), "goals")
    times, counts = slots(goal, block)
    goal = stored(goal.join(counts, "s", "left").select("s", "source_size", "target", "words", "docs", "i", "n"), "goals")
    total = int(goal.agg(F.sum("docs")).first()[0] or 0)
    rows = spread_join(rows, goal, "s", "docs", total).select("row", "id", "size", "source_size", "target", "words", "upto", "i", "n")
    rows = stored(rows, "mixed")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + F.col("upto") - F.col("size")))
    laid = rows.where("size > 0 and words > 0").select("row", "id", "i", "n", "words", "size", at.alias("x"))
    laid = laid.where("x < words").withColumn("y", F.least(F.col("x") + F.col("size"), F.col("words")))
    ks = F.sequence(_div(F.col("x"), F.col("n"), F.col("words")), _div(F.col("y") - 1, F.col("n"), F.col("words")))
    cut = laid.withColumn("b", F.explode(ks))
    first = F.greatest(F.col("x"), _div(F.col("b"), F.col("words"), F.col("n"), up=True))
    last = F.least(F.col("y"), _div(F.col("b") + 1, F.col("words"), F.col("n"), up=True))
    cut = cut.select("row", "id", "i", (F.col("b") + 1).alias("k"), (first - F.col("x")).alias("first"), (last - first).alias("length"))
    pieces = cut.join(times, ["i", "k"]).select(F.col("t").alias("slot"), "row", "id", "first", "length")
    return Mix(rows.select("row", "id", "size", "source_size", "target"), pieces)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    taken = mixed.pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    rows = mixed.rows.join(taken, "row", "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS whole FROM s),
f AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER () - sum(weight) OVER o + weight AS left_weight FROM w WINDOW o AS (ORDER BY cap * (6 // weight), place)),
g AS (SELECT *, 2 * cap * left_weight <= weight * (3 * whole - 2 * caps) AS filled FROM f),
r AS (SELECT coalesce(sum(cap) FILTER (filled), 0) AS filled_words, sum(weight) - coalesce(sum(weight) FILTER (filled), 0) AS rest FROM g),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (3 * whole / 2 - filled_words)::DOUBLE * weight / greatest(1, rest)::DOUBLE END AS target FROM g, r),
p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS words, sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(upto, words) - (upto - size)) + greatest(0, least(source_size + upto, words) - (source_size + upto - size)))::BIGINT AS taken FROM p
"""
