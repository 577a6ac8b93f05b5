"""Preference formatting on odd conversations."""

from __future__ import annotations

from quarry.llm.chat import positions, preference_pairs

TURNS = "id long, turn long, role string, text string, pos string, prompt string"


def turns(spark, rows):
    return positions(spark.createDataFrame([(*r, "own", "own") for r in rows], TURNS), "id")


def test_preference_pairs(spark):
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "user", "only"), (None, 0, "user", "lost"), (4, None, "user", "lost")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad one"), (2, 0, "user", ""), (2, 1, "unknown", "x"), (2, 2, "assistant", "more")]
    got = {r.id: r for r in preference_pairs(turns(spark, chosen), turns(spark, rejected), "id").collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one.n_prefix, one.prompt) == (2, "<|system|>\ns\n<|end|>\n<|user|>\nq\n<|end|>\n")
    assert (one.chosen, one.chosen_mask) == ("<|assistant|>\ngood\n<|end|>\n", "0:14,1:13")
    assert (one.rejected, one.rejected_mask) == ("<|assistant|>\nbad one\n<|end|>\n", "0:14,1:16")
    two = got[2]
    assert (two.n_prefix, two.chosen, two.chosen_mask) == (2, "", "")
    assert two.rejected == "<|assistant|>\nmore\n<|end|>\n"
    assert (got[3].n_prefix, got[3].prompt, got[3].chosen, got[3].rejected) == (0, "", "<|user|>\nonly\n<|end|>\n", "")
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(int(x.split(":")[1]) for x in mask.split(",") if x) == len(text)


def test_nothing(spark):
    assert preference_pairs(turns(spark, []), turns(spark, []), "id").count() == 0
