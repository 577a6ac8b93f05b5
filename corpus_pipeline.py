"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next one.

Defined results: rows with a null or empty text, or one without a letter, go in the first stage; so do all rows if no text is
labelled with a language, as none can be told. Rows with a null doc_id go through, but are neither copies of others nor
copied; exact repeats of a row stay or go together. Very long texts are worked on whole, an empty table gives no rows, and
other columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, langid, minhash, substring
from quarry.llm.common import WRITTEN, discard, shared_dir, spare, table

#: A text of whose n-grams fewer than this share are known in any learned language is in none of them.
LEAST_KNOWN = 0.05
#: Near duplicates share 0.8 of their shingles of five words. op3_minhash has another contract (three words, 0.85).
NEAR_WIDTH, NEAR_SIMILAR = 5, (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in none of the learned languages; a missing lang is filled in."""
    model = langid.learn(docs)  # all labelled rows: the fold is of op8_langid alone
    doc = F.col("doc")
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("doc")), model, id_col="doc", text_col=doc["text"], keep=("doc",))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_KNOWN))
    lang = F.coalesce(doc["lang"], "lang_pred")
    return found.select(*[(lang if c == "lang" else doc[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates. Rows of one doc_id with different texts are
    documents of their own."""
    copy, mark = spare(docs, "copy"), spare(docs, "copy_hash")
    found = minhash.near_duplicates(docs, width=NEAR_WIDTH, similar=NEAR_SIMILAR, text_hash=mark)
    copies = found.where("not kept").select(F.col("doc_id").alias(copy), mark).distinct()
    same = (docs["doc_id"] == copies[copy]) & (minhash.hash_of(docs["text"]) == copies[mark])
    return docs.join(copies, same, "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words and more that a document with a smaller doc_id has too."""
    return substring.dedup_substrings(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated with benchmark items, and cuts hit spans out of the others."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left (packed 32-bit integers) and the digest of the text they decode to."""
    coded = bpe.encode(docs, bpe.default_vocab())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("benchmarks", benchmarks),
    ("tokens", tokens),
]

#: SQL can express neither the language filters nor the tokens; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        before = set(WRITTEN)
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, [p for p in WRITTEN if p not in before])  # the stage has run: nothing reads its tables any more
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
