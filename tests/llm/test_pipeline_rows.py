"""Pipeline stages on rows without an id, rows that share one, and a rare language."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline as pipeline
from conftest import DATA

from quarry.llm import substring


def test_substrings_by_row(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    first, second, own = words(60), words(60), [words(20) for _ in range(4)]
    rows = [(1, f"{first} {second}"), (5, f"{own[0]} {first}"), (5, f"{own[1]} {second}"), (5, own[2]), (None, f"{own[3]} {second}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in substring.dedup_substrings(docs).collect())
    expected = [(1, rows[0][1]), (5, own[0]), (5, own[1]), (5, own[2]), (None, own[3]), (None, None)]
    assert got == sorted((str(i), str(t)) for i, t in expected)


def test_language_learns_from_every_labelled_row(spark):
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1][:6]
    georgian = "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით"
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(i, f"{georgian} {georgian[k:]}", "ka") for k, i in enumerate(held)], docs.schema)
    left = pipeline.language(spark, docs.unionByName(rare), DATA)
    assert sorted(r.doc_id for r in left.where("lang = 'ka'").collect()) == held
