"""Which texts contain which passages: an automaton of a bounded block of passages, streamed over the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranks import running
from quarry.sources.shared import stored

#: Characters of the passages of one automaton, which every Python worker holds. A longer passage is a block of its own.
BLOCK_CHARS = 1 << 20


def blocks(rows: DataFrame, order: str, size: Column, most: int) -> Iterator[list]:
    """The rows in order, collected in blocks of at most `most` of size (one row more at most). Only one block is on the driver at a time."""
    sized = rows.withColumn("__size", size.cast("long"))
    cut = running(sized, [], [F.col(order).asc()], rank="__n", sums={"__upto": "__size"})
    cut = stored(cut.withColumn("__block", F.floor((F.col("__upto") - F.col("__size")) / most)).drop("__n", "__upto", "__size"), "blocks")
    for number in sorted(r[0] for r in cut.select("__block").distinct().collect()):
        yield cut.where(F.col("__block") == number).drop("__block").collect()


def contained(docs: DataFrame, passages: DataFrame, *, key: str, text: str, passage_key: str, passage: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """passage_key and key of every text that contains the passage, once for each pair of rows.

    Equal passages are one word of the automaton, whose ids meet the hits by a join at the end. Every block of passages is one pass
    over the texts, and its hits are written out. Null and empty passages are in no text here, a null text contains none.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    asked = passages.select(F.col(passage_key).alias("passage_key"), F.col(passage).alias("passage")).where("length(passage) > 0")
    distinct = stored(asked.select("passage").distinct().withColumn("word", F.monotonically_increasing_id()), "passages")
    schema = texts.select("key", F.lit(0).cast("long").alias("word")).schema
    kind = pa.schema([("word", pa.int64())])

    def search(words: list[tuple[str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for passage_, word in words:
                automaton.add_word(passage_, word)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, value in enumerate(batch.column(1)):
                    hits = {word for _, word in automaton.iter(value.as_py())}
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, kind.field(0).type)], names=["key", "word"])

        return run

    parts = [stored(texts.mapInArrow(search([(r["passage"], r["word"]) for r in block]), schema), "hits") for block in blocks(distinct, "word", F.length("passage"), block_chars)]
    if not parts:
        return texts.select("key").limit(0).crossJoin(asked.select("passage_key").limit(0)).select(F.col("passage_key").alias(passage_key), F.col("key").alias(key))
    hits = reduce(DataFrame.unionByName, parts)
    named = asked.join(distinct, "passage").select("word", "passage_key")
    return hits.join(named, "word").select(F.col("passage_key").alias(passage_key), F.col("key").alias(key))


def parts_of(pieces: DataFrame, texts: DataFrame, *, piece: str, text: str, least: int) -> DataFrame:
    """The other way round, for many pieces and a stated set of texts: every piece of `least` characters and more with each text that
    contains it. The texts' grams of that length meet the pieces' heads, so no piece meets a text that does not hold its head.

    Columns of both sides are kept; their names must differ.
    """
    starts = F.sequence(F.lit(1), F.length(text) - least + 1)
    grams = texts.where(F.length(text) >= least).select("*", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(least))))).alias("__head"))
    heads = pieces.where(F.length(piece) >= least).withColumn("__head", F.left(F.col(piece), F.lit(least)))
    return heads.join(grams, "__head").where(F.contains(F.col(text), F.col(piece))).drop("__head")
