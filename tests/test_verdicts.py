"""Every branch of a case's verdict, and reports on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import verdicts as V

SCHEMA = "n int, category string, error string, answer string, has_results boolean, has_expected boolean, hit boolean, vals array<string>, crossed boolean, cited boolean, keywords array<string>"
NO = "没有找到相关的文献"
#: category, error, answer, has_results, has_expected, hit, values, crossed, cited, keywords -> passed, unjudged
BRANCHES = [
    (("fact", "boom", "all right", True, True, True, [], False, False, []), (False, False)),
    (("edge", "boom", "x", False, False, False, [], False, False, []), (False, False)),
    (("refusal", None, None, True, False, False, [], False, False, []), (True, True)),
    (("refusal", None, NO, True, False, False, [], False, False, []), (True, False)),
    (("refusal", None, "It is 42.", True, False, False, [], False, True, []), (False, False)),
    (("edge", None, "  ", False, False, False, [], False, False, []), (False, False)),
    (("edge", None, "hm", False, True, False, [], False, False, []), (True, False)),
    (("edge", None, None, True, False, False, [], False, False, []), (True, False)),
    (("edge", None, None, True, True, True, [], False, False, []), (False, False)),
    (("metadata", None, None, True, True, False, ["a"], False, False, []), (False, False)),
    (("metadata", None, None, False, False, False, ["a"], False, False, []), (True, False)),
    (("metadata", None, "Ann, 2024.", True, True, False, ["ann", "2024"], False, False, []), (True, False)),
    (("metadata", None, "Ann", True, True, True, ["ann", "2024"], False, False, []), (False, False)),
    (("metadata", None, "Ann", True, True, True, [], False, False, []), (False, False)),
    (("fact", None, None, True, True, True, [], False, False, ["a"]), (True, False)),
    (("fact", None, None, True, True, False, [], False, False, ["a"]), (False, False)),
    (("fact", None, None, False, True, True, [], False, False, ["a"]), (False, False)),
    (("fact", None, "one two", True, True, True, [], False, False, ["one", "four"]), (True, False)),
    (("fact", None, "one two", True, True, True, [], False, False, ["one", "four", "five"]), (False, False)),
    (("fact", None, "one two", True, True, False, [], False, False, ["one"]), (False, False)),
    (("fact", None, "one two", True, True, True, [], False, False, ["", " "]), (True, False)),
    (("fact", None, "one two", False, False, False, [], False, False, []), (False, False)),
    (("fact", None, "one two", False, False, False, [], True, True, ["nine"]), (True, False)),
    (("fact", None, "one two", False, False, False, [], True, False, ["nine"]), (False, False)),
    (("fact", None, "one two", False, False, False, [], True, False, ["one"]), (True, False)),
]


def test_branches(spark):
    rows = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(BRANCHES)], SCHEMA)
    c = {name: F.col(name) for name in rows.columns}
    found = V.case_verdict(
        category=c["category"], error=c["error"], answer=c["answer"], has_results=c["has_results"], has_expected=c["has_expected"], values=c["vals"], crossed=c["crossed"], cited=c["cited"],
        retrieval=V.retrieval_verdict(c["has_results"], c["has_expected"], c["hit"], F.lit(False)), keywords=F.when(c["answer"].isNotNull(), V.keyword_verdict(c["answer"], c["keywords"])),
    )
    got = [(r.v.passed, r.v.unjudged) for r in rows.select("n", found.alias("v")).orderBy("n").collect()]
    assert got == [want for _, want in BRANCHES]


def test_cites(spark):
    said = lambda answer, *titles: spark.range(1).select(V.cites(F.lit(answer), F.array(*map(F.lit, titles)).cast("array<string>"))).first()[0]
    assert said("See “Deep Sets, revisited”.", "short", "Deep sets and more") and not said("See deep", "Deep sets and more") and not said("short", "short") and not said("x")


def test_best_cut_takes_the_smallest(spark):
    swept = spark.createDataFrame([(0.1, 1.0, 0.5, 0.5), (0.2, 0.9, 0.7, 0.6), (0.3, 0.8, 0.8, 0.6)], "cut double, pass_rate double, reject_rate double, youden double")
    assert tuple(V.best_cut(swept).first()) == (0.2, 0.9, 0.7, 0.6)
    assert V.best_cut(swept.limit(0)).count() == 0


def test_class_totals(spark):
    rows = spark.createDataFrame([("a", "a", 10.0), ("a", "b", 20.0), ("b", "b", 30.0), ("c", "a", 40.0), ("c", None, 50.0), ("c", "a", 60.0)], "gold string, pred string, ms double")
    r = V.overall(rows, "gold", "pred", "ms").first()
    assert (r.n, r.accuracy, r.mean_ms, r.p50_ms) == (6, round(2 / 6, 6), 35.0, 40.0)
    assert r.macro_f1 == pytest.approx((2 / 5 + 2 / 3) / 2, abs=1e-6)  # c has no F1
    assert [tuple(x) for x in V.confusions(rows, "gold", "pred", 1).collect()] == [("c", "a", 2)]
