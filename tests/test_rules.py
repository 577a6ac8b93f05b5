"""Rules of curation, sources and outputs on small cases, against plain Python where there is more than one step."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import curate as D
from quarry.operators import evaluate as E
from quarry.operators import logs as A
from quarry.operators import retrieve as R


def capped(sources, answer, cap):
    """sources: (place, n, a, b). What stays, in order."""
    seen, unique = set(), []
    for row in sources:
        key = ("" if row[2] is None else row[2], "" if row[3] is None else row[3])
        if key not in seen:
            seen.add(key)
            unique.append(row)
    order = sorted(unique, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    if len(order) <= cap:
        return [r[0] for r in order]
    cited = {int(x) for x in re.findall(r"\[(?:资料)?([0-9]{1,2})\]", answer or "")}
    kept = [r for r in order if r[1] in cited]
    rest = [r for r in order if r[1] not in cited][: max(0, cap - len(kept))]
    return [r[0] for r in sorted(kept + rest, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]


def test_capped_sources(spark):
    rng = random.Random(2)
    sources, answers, want = [], [], {}
    for q in range(30):
        rows = [(i, rng.choice([None, i + 1, i + 1]), rng.choice(["", None, "x", "y"]), rng.choice(["p", "q", None, *"abcdefgh"])) for i in range(rng.randrange(1, 30))]
        text = rng.choice([None, "none", "".join(f"[{n}] [资料{n + 1}] [1{n}0]" for n in rng.sample(range(1, 30), 9)), "".join(f"[{n}]" for n in range(40))])
        want[q] = capped(rows, text, 5)
        sources += [(q, *r) for r in rows]
        if text is not None or q % 2:
            answers.append((q, text))
    df = spark.createDataFrame(sources, "q int, pos int, n int, a string, b string")
    out = R.cap_sources(df, spark.createDataFrame(answers, "q int, text string"), "q", "pos", "n", ["a", "b"], cap=5)
    got: dict[int, list] = {q: [] for q in want}
    for r in out.orderBy("q", "place").collect():
        got[r.q].append(r.pos)
    assert got == want


def test_scoped_confidence(spark):
    cases = [((True, True, False, 1), True), ((False, True, False, 1), False), ((False, True, True, 1), True), ((False, True, True, 0), False), ((True, False, True, 3), None)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, c boolean, r boolean, f boolean, h int")
    got = df.select("i", R.scoped_confidence(F.col("c"), F.col("r"), F.col("f"), F.col("h")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [want for _, want in cases]
    kept = spark.createDataFrame([(None,), ("",), ("metadata_query",), ("simple_qa",)], "i string").select(R.keeps_references(F.col("i")).alias("x"))
    assert [r.x for r in kept.collect()] == [True, True, True, False]


def test_accepted_outputs(spark):
    cases = [
        ("rewrite", "abc", "x" * 65, "accepted"), ("rewrite", "abc", "x" * 66, "too_long"), ("rewrite", "abc", "  ", "empty"), ("rewrite", "abc", None, "empty"),
        ("translation", "abc", '"' + "x" * 92 + '"', "accepted"), ("translation", "abc", "x" * 93, "too_long"), ("translation", "abc", "\"''\"", "empty"),
        ("translation", "abc", "文" * 3 + "x" * 17, "not_translated"), ("translation", "abc", "文" * 2 + "x" * 18, "accepted"), ("intent", "q", " group_report ", "accepted"), ("intent", "q", "other", "unknown"), ("intent", "q", "", "empty"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, asked string, said string, want string")
    rows = df.select("*", A.accepted(F.col("kind"), F.col("asked"), F.col("said")).alias("got")).collect()
    assert [(r.i, r.got) for r in rows] == [(r.i, r.want) for r in rows]


def test_cost_by_intent(spark):
    calls = [(["u", "intent:a", "intent:b"], 5), (["intent:a"], 1), (["intent:"], 9), (None, 1), ([], None)]
    rows = A.cost_by_intent(spark.createDataFrame(calls, "tags array<string>, n long"), "tags", "n").orderBy("place").collect()
    assert [tuple(r) for r in rows] == [(A.UNLABELLED, 10, 3, 0.625, 1, False), ("a", 6, 2, 0.375, 2, False)]
    none = A.cost_by_intent(spark.createDataFrame([(["intent:a"], 0)], "tags array<string>, n long"), "tags", "n").first()
    assert (none.share, none.top) == (None, True)


def test_cleared_threads(spark):
    turns = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "thread string, n int")
    saved = spark.createDataFrame([(7,), (8,)], "id int")
    kept, removed = A.clear_threads({"turns": (turns, "thread"), "saved": (saved, "id")}, spark.createDataFrame([(" a",), ("a",), (" ",), (None,), ("7",)], "thread string"))
    assert {(r.thread, r.part): r.removed for r in removed.collect()} == {("a", "turns"): 2, ("a", "saved"): 0, ("7", "turns"): 0, ("7", "saved"): 1}
    assert sorted((r.thread or "", r.n) for r in kept["turns"].collect()) == [("", 1), ("b", 1)] and kept["saved"].columns == ["id"]


ZH = "深度学习方法在图像识别中的应用研究"


@pytest.mark.parametrize(
    "question, sources, want",
    [
        ("one two three four", [(1, "one two three four")], (0, 0, None, 0, True)),
        (None, [(1, "one")], (0, 0, None, 0, True)),
        ("a, b c D e f!", [(1, "x a b c d e y"), (2, None), (3, "")], (2, 1, 1, 1, True)),
        ("a b c d e f", [(9, "z a b c d e f"), (4, "a b c d e f a b c d e"), (5, "b c d e f")], (2, 3, 4, 2, False)),
        (ZH, [(1, "前言。" + ZH[:12] + "，" + ZH[12:]), (2, ZH[:6])], (13, 2, 1, 13, False)),
        (ZH, [(1, "english " * 40 + ZH)], (13, 0, None, 0, True)),
    ],
)
def test_question_overlap(spark, question, sources, want):
    q, s = spark.createDataFrame([(1, question)], "i int, q string"), spark.createDataFrame(sources, "k int, t string")
    r = D.question_overlap(q, s, key="i", question="q", source_key="k", source="t").first()
    assert (r.grams, r.sources, r.nearest, r.shared, r.kept) == want


def test_question_overlap_of_many_grams(spark, monkeypatch):
    """Several blocks of grams, repeated and null source keys, words that only some questions have, against sets of grams."""
    rng = random.Random(11)
    text = lambda most: " ".join(rng.choices("abcd", k=rng.randrange(most)) + rng.choices(["e", ""], k=1))
    asked = [(i, text(14)) for i in range(40)] + [(50, ZH), (51, "a b c d"), (52, None)]
    held = [(i, text(60)) for i in range(60)] + [(3, text(60)), (None, text(60)), (70, ZH[2:]), (71, "a b c d"), (72, None)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    of = lambda t: grams(list(t) if t in (ZH, ZH[2:]) else (t or "").split())
    sources: dict = {}
    for k, t in held:
        sources.setdefault(k, set()).update(of(t))
    want = {}
    for i, t in asked:
        shared = {k: len(of(t) & g) for k, g in sources.items() if of(t) & g}
        best = min(((-n, k is not None, k or 0) for k, n in shared.items()), default=None)
        n = -best[0] if best else 0
        want[i] = (len(of(t)), len(shared), best[2] if best and best[1] else None, n, n <= 0.65 * len(of(t)))
    q, s = spark.createDataFrame(asked, "i int, q string"), spark.createDataFrame(held, "k int, t string")
    for size in (1 << 22, 100):
        monkeypatch.setattr(D, "GRAM_CHARS", size)
        df = D.question_overlap(q, s, key="i", question="q", source_key="k", source="t")
        assert {r.i: (r.grams, r.sources, r.nearest, r.shared, r.kept) for r in df.collect()} == want
    assert any(x[1] for x in want.values()) and {x[4] for x in want.values()} == {True, False}


def test_keywords(spark):
    words = F.array(*map(F.lit, [" model ", "Data", "tree", "abc", "图", "图像", ""]))
    source = F.lit("Mo-del of 图 像")
    r = spark.range(1).select(D.kept_keywords(words).alias("k")).select("k", D.missing_keywords(F.col("k"), source).alias("m"), D.keywords_hold(F.col("k"), source).alias("ok"), D.keywords_hold(F.col("k"), F.lit(None)).alias("none")).first()
    assert (r.k, r.m, r.ok, r.none) == (["model", "tree", "图像"], ["tree"], True, False)
    assert not spark.range(1).select(D.keywords_hold(F.array().cast("array<string>"), source)).first()[0]


@pytest.mark.parametrize(
    "turns, title, answer, words, want",
    [
        (["About Deep Sets?", "And?", "它 what"], "Deep Sets and more", "yes", ["model", "tree"], True),
        (["About deep sets?", "And?", "它 what"], "Deep Sets and more", "yes", ["model", "tree"], False),
        (["About Deep Sets?", " ", "它 what"], "Deep Sets", "yes", ["model", "tree"], False),
        (["About Deep Sets?", "And?", "what"], "Deep Sets", "yes", ["model", "tree"], False),
        (["About Deep Sets?", "And?", "这个"], "", "yes", ["model", "tree"], False),
        (["About Deep Sets?", "And?", "这个"], None, "yes", ["model", "tree"], False),
        (["About Deep Sets?", "And?", "这个"], "Deep", " ", ["model", "tree"], False),
        (["About Deep Sets?", "And?", "这个"], "Deep", "yes", ["model", "the"], False),
        (["About Deep Sets?", "And?", None], "Deep", "yes", ["model", "tree"], False),
    ],
)
def test_three_turns(spark, turns, title, answer, words, want):
    df = spark.createDataFrame([(turns, title, answer, words)], "t array<string>, title string, answer string, w array<string>")
    assert df.select(D.three_turn_case(F.col("t"), F.col("title"), F.col("answer"), F.col("w"))).first()[0] is want


def test_capped_sample(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "item int, k int")
    first = D.capped_sample(rows, "item", ["k"], F.col("k"), cap=2, n=5)
    assert sorted(r.k for r in first.collect()) == [0, 1, 2, 3, 4]
    again = D.capped_sample(rows, "item", ["k"], F.col("k"), cap=F.when(F.col("item") == 0, 3).otherwise(1), n=99, used=first)
    assert sorted(r.k for r in again.collect()) == [5, 6, 7, 9, 12] and again.columns == ["item", "k"]


def test_case_correctness(spark):
    cases = [
        (("metadata", "metadata_query", None), (True, None)), (("en_fact", "summary_paper", "1"), (False, None)), (("metadata", "", None), (None, None)), (("metadata", None, None), (None, None)),
        (("refusal", "simple_qa", None), (None, None)), (("coreference", "simple_qa", "2"), (None, True)), (("coreference", "", "3"), (None, False)), (("coreference", "", ""), (None, None)), ((None, "x", None), (None, None)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, c string, t string, r string")
    intent, item = E.case_correctness(F.col("c"), F.col("t"), F.col("r"), F.array(F.lit("1"), F.lit("2")))
    assert [(r.a, r.b) for r in df.select("i", intent.alias("a"), item.alias("b")).orderBy("i").collect()] == [want for _, want in cases]
