"""The most similar of many names, exactly: a trie of the names walked with shared rows of the edit-distance table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each name (-1 beyond its end) and lengths."""
    size = np.array([len(x) for x in names])
    letters = np.full((len(names), int(size.max())), -1, dtype=np.int32)
    for k, x in enumerate(names):
        letters[k, : len(x)] = [ord(c) for c in x]
    return letters, size


def _next_row(row: np.ndarray, letters: np.ndarray, code: int, at: np.ndarray) -> np.ndarray:
    """The distance rows of several names after one more letter of the other word."""
    to = np.empty_like(row)
    to[:, 0] = row[:, 0] + 1
    np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != code), out=to[:, 1:])
    return np.minimum.accumulate(to - at, axis=1) + at


def most_similar(names: list[str], files: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """Per name each file of the best similarity, if that is `least` or more; names and files are distinct and not empty.

    The similarity is 1 - Levenshtein distance / longer length. Files are walked as a trie (a range of the sorted files and the
    length of their common head), with one row of the table for each name still open; files that share a head share its rows. A
    name leaves a branch if even the best completion there stays below the best similarity that it has found so far: the
    remaining letters cost at least the difference to the remaining lengths in the branch. Branches with files of about a
    name's length are entered alike; what each name finds first is next to it in sorted order.
    """
    files = sorted(files)
    letters, size = _letters(names)
    codes, file_size = _letters(files)
    at = np.arange(letters.shape[1] + 1, dtype=np.int32)
    best = np.full(len(names), least)
    found: dict[int, list[tuple[int, float]]] = {}

    def settle(name: np.ndarray, file: int, distance: np.ndarray) -> None:
        score = 1 - distance / np.maximum(size[name], file_size[file])
        for k, s in zip(name[score >= best[name] - 1e-9].tolist(), score[score >= best[name] - 1e-9].tolist()):
            found.setdefault(k, []).append((file, s))
            best[k] = max(best[k], s)

    neighbour = np.searchsorted(np.array(files, dtype=object), np.array(names, dtype=object)) if len(files) > 1 else np.zeros(len(names), int)
    for shift in (-1, 0):  # a first bound for each name
        for k, f in enumerate(np.clip(neighbour + shift, 0, len(files) - 1).tolist()):
            row = at[None, : size[k] + 1].copy()
            for code in codes[f, : file_size[f]].tolist():
                row = _next_row(row, letters[k : k + 1, : size[k]], code, at[: size[k] + 1])
            best[k] = max(best[k], 1 - row[0, size[k]] / max(size[k], file_size[f]))

    every = np.arange(len(names))
    stack = [(0, len(files), 0, every, np.tile(at, (len(names), 1)))]
    while stack:
        low, high, depth, name, row = stack.pop()
        # files that end here are the first ones of the range
        while low < high and file_size[low] == depth:
            settle(name, low, row[np.arange(len(name)), size[name]])
            low += 1
        if low == high:
            continue
        left, right = int(file_size[low:high].min()) - depth, int(file_size[low:high].max()) - depth
        rest = size[name][:, None] - at  # letters of the name that are still to come
        cost = row + np.maximum(0, np.maximum(left - rest, rest - right))
        cost[rest < 0] = 1 << 20
        able = 1 - cost.min(axis=1) / np.maximum(size[name], depth + right) >= best[name] - 1e-9
        if not able.any():
            continue
        name, row = name[able], row[able]
        heads = codes[low:high, depth]
        edges = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), high - low]
        for a, b in reversed(list(zip(edges[:-1], edges[1:]))):
            stack.append((low + a, low + b, depth + 1, name, _next_row(row, letters[name], int(heads[a]), at)))
    for k, hits in found.items():
        yield from ((names[k], files[f], s) for f, s in hits if s >= best[k] - 1e-9)
