"""Spelling variants against all pairs, on words of few letters, with ties, chains and odd texts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm.spelling import near_pairs, prefix_and_pivots, variants

SCHEMA = "doc_id long, text string, word string, n string, h long, near string, root string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "own", "own", 7, "own", "own") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters,seed", [("ab", 0), ("abc", 1), ("aé÷", 2), ("abcdefgh", 3)])
def test_near_pairs_of_all_words(spark, letters, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(160)}
    for w in list(words):
        i, c = rng.randrange(len(w) + 1), rng.choice(letters)
        words |= {x for x in (w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]) if len(x) >= 6}
    words |= {"a" * n for n in range(6, 12)} | {"ab" * 50, "ab" * 50 + "a", "b" + "ab" * 50, "x" * 4000, "x" * 4001}
    got = [(r.word, r.near) for r in near_pairs(spark.createDataFrame([(w, 7) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_pivots_are_disjoint_and_least():
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 14)))
        grams = [word[i : i + 2] for i in range(len(word) - 1)]
        number = {g: k for k, g in enumerate(rng.sample(sorted(set(grams)), len(set(grams))))}
        prefix, (a, b) = prefix_and_pivots(word, number)
        assert {a, b} <= set(prefix) and b - a >= 2
        pairs = [number[grams[x]] + number[grams[y]] for x in prefix for y in prefix if y - x >= 2]
        assert number[grams[a]] + number[grams[b]] == min(pairs)


def test_variants_of_texts(spark):
    rng = random.Random(4)
    common = ["important", "Señorita", "mañanas", "running", "straße", "HOUSES", "÷÷÷÷÷÷×"]
    rows = []
    for doc in range(60):
        words = [rng.choice(common) for _ in range(60)]
        for k, w in enumerate(words):
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + "o" + w[i + 1 :]])
        rows.append((doc, " ".join(words) + ", " + "4x" + "-".join(words[:3])))
    rows += [(100, None), (101, ""), (None, "important " * 40), (7, rows[7][1]), (7, rows[7][1]), (102, "importans " * 4000), (103, "z" * 5000 + " " + "z" * 4999)]
    # a chain of forms, each five times as frequent, and a tie between two forms
    rows += [(200 + i, "chained " * (5 * 6**k) if k < 4 else "") for i, k in enumerate(range(4))]
    rows += [(300, "abcdefg " * 5 + "abcdefh " * 25 + "abcdexh " * 125 + "abcdyxh " * 640 + "tieing1 tieingx " * 5 + "tieinga " * 30 + "tieingb " * 30)]
    rows += [(400 + i, "zzzzzz" + "abcdefgh"[i % 8]) for i in range(80)]
    got, want = found(spark, rows), brute(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 2 for r in want)


def test_broken_runs(spark):
    """Runs whose hash 199 divides lose a code point, in whatever row they stand."""
    rows = [(i, f"{'unbroken'} {'éclairée'}") for i in range(1500)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert sum(r[3] for r in want) < 3000 or len(want) > 2
    by_row = defaultdict(int)
    for i, _ in rows:
        by_row[zlib.crc32(f"{i}:unbroken".encode()) % 199 == 0] += 1
    assert by_row[True] > 0


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, "a b c"), (2, None)]) == []


def test_no_words_are_broadcast(spark):
    """The files of the words may be small where their keys are not: 56 rows a word."""
    docs = spark.createDataFrame([(i, " ".join(["wording", "wordings", "swordings"] * 5)) for i in range(3)], "doc_id long, text string")
    pairs = near_pairs(spark.createDataFrame([("wording", 9), ("wordings", 5)], "word string, n long"))
    every = variants(docs)
    for df in (pairs, every):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
