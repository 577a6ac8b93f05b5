"""Recompression on random texts with small vocabularies, the exchanges between batches done in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarry.llm import substring
from quarry.llm.repeats import Batch, covered

N = 5


def exchange(sent, compare):
    """What Spark does between batches: lists by bucket, answers by batch."""
    answers = [{} for _ in sent]
    for bucket in sorted({b for lists in sent for b in lists}):
        at = [i for i, lists in enumerate(sent) if bucket in lists]
        for i, reply in zip(at, compare([sent[i][bucket] for i in at], bucket)):
            answers[i][bucket] = reply
    return answers


def removed(batches):
    rounds = []
    for turn in range(len(substring.RUNS)):
        sent = []
        for k, batch in enumerate(batches):
            words, x = substring.recompressed(batch, N, *[r[k] for r in rounds])
            sent.append(dict(substring.send_pairs(x, words, N)))
        rounds.append(exchange(sent, substring.name_pairs(turn)))
    found = []
    for k, batch in enumerate(batches):
        words, x = substring.recompressed(batch, N, *[r[k] for r in rounds])
        found.append((words, *substring.window_keys(words, x)))
    shared = exchange([dict(substring.send_keys(keys, words.doc[starts], N)) for words, starts, keys, _ in found], substring.compare_keys)
    windows = []
    for batch, (words, starts, keys, levels), answer in zip(batches, found, shared):
        starts = starts[substring.shared_keys(keys, words.doc[starts], N, answer)]
        windows.append((words, starts, substring.window_names(levels, starts), batch.ids[words.doc[starts]]))
    earlier = exchange([dict(substring.send_names(names, ids, N)) for _, _, names, ids in windows], substring.compare_names)
    out = []
    for batch, (words, starts, names, ids), answer in zip(batches, windows, earlier):
        gone = covered(starts[substring.repeated_names(names, ids, N, answer)], substring.WINDOW, len(words.name))
        out += [gone[words.doc == d].tolist() for d in range(len(batch.ids))]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_random_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" * rng.randint(1, 5) for i in range(rng.choice([1, 2, 3, 10, 200]))]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(rng.randint(50, 70)) for _ in range(3)] + [(text(rng.randint(1, 5)) * 60)[:80]]
    docs = []
    for i in range(12):
        words = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages)[rng.randint(0, 3) :] + text(rng.randint(0, 12))
        docs.append((rng.randint(0, 9), words))
    batches = []
    for at in range(0, len(docs), 4):
        bodies = [rng.choice([" ", "\n", "  "]).join(words).encode() for _, words in docs[at : at + 4]]
        ids = np.array([i for i, _ in docs[at : at + 4]], dtype="<i8")
        batches.append(Batch(at, ids, np.array(list(map(len, bodies))), b"".join(bodies)))
    least = {}
    for i, words in docs:
        for s in range(len(words) - 49):
            window = tuple(words[s : s + 50])
            least[window] = min(i, least.get(window, i))
    expected = []
    for i, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - 49):
            if least[tuple(words[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        expected.append(gone)
    assert removed(batches) == expected


def test_equal_windows_have_equal_symbols_inside():
    """Borders from EDGE words inside a window on, and the symbols between them, do not depend on what is around the window."""
    rng = random.Random(1)
    for _ in range(300):
        vocabulary = [f"v{i}" for i in range(rng.choice([2, 3, 5, 50]))]
        text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
        window, seen = text(50), set()
        for _ in range(4):
            before = text(rng.randint(0, 30))
            body = " ".join(before + window + text(rng.randint(0, 30))).encode()
            batch = Batch(0, np.zeros(1, "<i8"), np.array([len(body)]), body)
            words = substring.words_of(batch)
            x = substring.Symbols(words.name, np.arange(len(words.name)), np.zeros(len(words.name), bool), *(np.zeros(0, np.int64),) * 3)
            for turn in range(2):
                x = substring.joined(x, words, turn)
            at = x.start - len(before)
            inside = (at >= substring.EDGE) & (np.append(at[1:], 10**6) <= 50 - substring.EDGE)
            assert ((at >= substring.EDGE) & (at < substring.EDGE + substring.SPAN)).any()
            seen.add((tuple(at[(at >= substring.EDGE) & (at <= 50 - substring.EDGE)]), tuple(x.name[inside])))
        assert len(seen) == 1
