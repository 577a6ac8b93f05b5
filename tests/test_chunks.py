"""Child and parent chunks against their SQL on texts with every case of the fold."""

from __future__ import annotations

import random

import duckdb
import pytest
from conftest import same_rows

from quarry.plans.registry import ORACLE_SQL, QUERIES


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    line = lambda: " ".join(sentence(rng.choice([1, 5, 30, 90])) for _ in range(rng.randint(3, 40)))
    yield from (None, "", "  \n ", "short title", "x" * 5000, "A." * 900, "one. " * 700)
    yield "".join(rng.choice("中文字符。！？") for _ in range(3000))  # sentences of Chinese signs, which weigh more
    yield "中" * 2500 + "。 " + "(),;:" * 400 + ". Then a plain end of it."
    for _ in range(25):
        yield "\n".join(rng.choice([line, lambda: "Title " + word(), lambda: "a | b | " + word(), lambda: "中文" * rng.randint(20, 800) + "。" + line()])() for _ in range(12))
    yield "\n".join(["y" * 2000 + ". Next One goes on and is long enough to be a text."] * 6)


@pytest.mark.parametrize("name", ["c14_children", "c15_parents"])
def test_chunks_equal_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() > 200
    same_rows(found, con.sql(ORACLE_SQL[name]))
