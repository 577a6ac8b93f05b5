"""Substring dedup by recompression: repeated windows of 50 words, the first copy kept.

A word is a symbol, named by a 64-bit hash. Each of two rounds joins runs of equal symbols and pairs of a left and a right symbol;
which symbols are left or right is a bit of their name, so equal pieces of text are cut into equal symbols everywhere, but for the
symbols near their ends. At the end of a round, Spark names what was joined: every batch of documents sends the pairs of names
that its new symbols stand for, the bucket of a pair gives it one number if several documents have it, and the batch reads the
numbers back as the names of the next round. Symbols of one document only get no number.

* Interior symbols. Runs have up to RUNS words and symbols up to SIZES words. Where a symbol ends depends on the words around:
  a run of a round is known where the symbols of RUNS words and one more are, a pair where both of its symbols are. Counted through
  two rounds of (2, 4) and (4, 8) words, borders from EDGE = 17 words inside a window on, and all symbols between them, are the
  same in all equal windows. No symbol is longer than 8 words, so there is a border among any 8 places.
* High-level symbols. A border's phrase is named by the symbols that lie within REACH = 9 words after it and by the LONG = 20 words
  after it. A window is known by the smallest phrase at the SPAN = 8 places from EDGE on: two equal windows have the same one. Windows
  with a symbol of one document only among those that are their own are unique and drop out; a third exchange drops the
  windows whose phrase only one document has.
* Verification. The windows that are left get a 96-bit name of all their 50 words, and a last exchange finds for each name the
  smallest doc_id. A window is removed if a document with a smaller doc_id has it. Names stand for words here: the words
  themselves would take several times the disk, and two of 10^12 different windows share a name with probability 10^-5.

Memory: a task holds one batch of a few MB, or the lists of one bucket, whose number follows the input (`repeats.py`).

Defined results: null, empty and short texts keep all their words; rows with the same doc_id do not remove from each other;
rows with a null doc_id come after all others and do not remove from each other; a text longer than a batch is a batch of its own,
read whole; an empty table gives no rows; other columns, whatever their names, are not read and stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import spare, table
from quarry.llm.repeats import NO_ID, Batch, ask, batches_of, bucket_count, bucket_of, covered, mix, named, pack, sliding_least

WINDOW = 50
RUNS = (2, 4)
SIZES = (4, 8)
EDGE = 17
SPAN = 8
REACH = 9
LONG = 20

_NAME = np.dtype([("a", "<u8"), ("b", "<u4")])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first 0, 1, ... 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Set in names that are hashes, and not in the numbers that Spark gives.
_HASH = np.uint64(1 << 63)
_NONE = np.iinfo(np.uint64).max


@dataclass
class Words:
    """The words of a batch: where each begins and ends in the body, its document, and its name; and the words of each document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    name: np.ndarray
    counts: np.ndarray


def words_of(batch: Batch) -> Words:
    data = np.frombuffer(batch.body, dtype=np.uint8)
    ends = np.cumsum(batch.sizes)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    border = ends[ends < len(data)]  # a document's words end with it
    first[border] = inside[border + 1]
    last[border[border > 0] - 1] = inside[border[border > 0]]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(ends, start, side="right")
    # names of eight bytes at a time
    size = end - start
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=batch.body + bytes(8), strides=(1,))
    name = mix(size.astype(np.uint64), 1)
    at, k = np.arange(len(start)), 0
    while len(at):
        left = size[at] - 8 * k
        name[at] = named(name[at], eight[start[at] + 8 * k] & _FIRST[np.minimum(left, 8)], 2)
        at, k = at[left > 8], k + 1
    return Words(start, end, doc, name | _HASH, np.bincount(doc, minlength=len(ends)))


@dataclass
class Symbols:
    """Symbols one after another: name, first word, and if only one document has it. After a round that is not named yet, made
    are the new symbols (positions), and left and right what they stand for."""

    name: np.ndarray
    start: np.ndarray
    alone: np.ndarray
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray


def joined(x: Symbols, words: Words, turn: int) -> Symbols:
    """A round of recompression: short runs, then pairs. New names are hashes so far."""
    total = len(words.name)
    name, start, alone = x.name, x.start, x.alone
    doc = words.doc[start]
    left, right = np.zeros_like(name), np.zeros_like(name)
    made = np.zeros(len(name), dtype=bool)
    # runs of equal symbols of one document, if they are short
    first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])) if len(name) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(name)))
    size = np.diff(np.append(start, total))
    short = (many > 1) & (np.add.reduceat(size, first) <= RUNS[turn]) if len(first) else many > 1
    keep = np.ones(len(name), dtype=bool)
    keep[1:] = ~(np.repeat(short, many)[1:] & (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]))
    at = first[short]
    left[at], right[at], made[at] = name[at], many[short].astype(np.uint64), True
    name = name.copy()
    name[at] = named(left[at], right[at], 10 + turn) | _HASH
    name, start, alone, left, right, made, doc = (v[keep] for v in (name, start, alone, left, right, made, doc))
    # pairs of a left and a right symbol of one document
    size = np.diff(np.append(start, total))
    second = (mix(name, 20 + turn) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(~second[:-1] & second[1:] & (doc[1:] == doc[:-1]) & (size[:-1] + size[1:] <= SIZES[turn]))
    left[at], right[at], made[at] = name[at], name[at + 1], True
    alone = alone.copy()
    alone[at] |= alone[at + 1]
    name[at] = named(left[at], right[at], 30 + turn) | _HASH
    keep = np.ones(len(name), dtype=bool)
    keep[at + 1] = False
    name, start, alone, left, right, made = (v[keep] for v in (name, start, alone, left, right, made))
    made &= ~alone  # what holds a symbol of one document is of one document
    at = np.flatnonzero(made)
    return Symbols(name, start, alone, at, left[at], right[at])


_PAIR = np.dtype([("left", "<u8"), ("right", "<u8")])


def pairs_of(x: Symbols, words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the new symbols stand for, each pair once in order; if several documents of the batch have it; its bucket; and the
    place of every new symbol's pair."""
    name = x.name[x.made]  # a hash of the pair: equal pairs stand together
    order = np.argsort(name, kind="stable")
    left, right, doc = x.left[order], x.right[order], words.doc[x.start[x.made[order]]]
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    pairs = np.zeros(len(first), dtype=_PAIR)
    pairs["left"], pairs["right"] = left[first], right[first]
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return pairs, many, bucket_of(name[order][first], n), where


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def send_pairs(x: Symbols, words: Words, n: int) -> Iterator[tuple[int, bytes]]:
    pairs, many, bucket, _ = pairs_of(x, words, n)
    for b, part in by_bucket(bucket):
        yield b, pairs["left"][part].tobytes() + pairs["right"][part].tobytes() + np.packbits(many[part]).tobytes()


def name_pairs(turn: int):
    """The names of one bucket's pairs: to each list a bit for each pair, and the numbers of those that several documents have.

    A number is made of the round, the bucket and the pair's place in the bucket, so no two pairs have the same one.
    """

    def answer(lists: list[bytes], bucket: int) -> list[bytes]:
        sizes = [_pairs_in(x) for x in lists]
        left = np.concatenate([np.frombuffer(x, "<u8", k) for x, k in zip(lists, sizes)])
        right = np.concatenate([np.frombuffer(x, "<u8", k, 8 * k) for x, k in zip(lists, sizes)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=16 * k), count=k) for x, k in zip(lists, sizes)]).astype(bool)
        order = np.lexsort((right, left))
        new = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])])
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.cumsum(new) - 1
        shared = np.bincount(where) > 1
        shared[where[many]] = True
        number = np.uint64((turn + 1) << 61) | np.uint64(bucket << 32) | np.cumsum(shared).astype(np.uint64)
        cuts = np.cumsum(sizes)[:-1]
        return [np.packbits(bits).tobytes() + names[bits].astype("<u8").tobytes() for bits, names in zip(np.split(shared[where], cuts), np.split(number[where], cuts))]

    return answer


def _pairs_in(data: bytes) -> int:
    """The number of pairs in a list of k pairs of 16 bytes and k bits."""
    k = len(data) * 8 // 129
    while 16 * k + (k + 7) // 8 < len(data):
        k += 1
    return k


def read_names(x: Symbols, words: Words, n: int, answers: dict[int, bytes]) -> Symbols:
    """The symbols with the names that Spark has given to the new ones."""
    pairs, _, bucket, where = pairs_of(x, words, n)
    number = np.zeros(len(pairs), dtype=np.uint64)
    for b, part in by_bucket(bucket):
        answer = answers[b]
        bits = np.unpackbits(np.frombuffer(answer, np.uint8, (len(part) + 7) // 8), count=len(part)).astype(bool)
        number[part[bits]] = np.frombuffer(answer, "<u8", offset=(len(part) + 7) // 8)
    name, alone, found = x.name.copy(), x.alone.copy(), number[where]
    name[x.made] = np.where(found > 0, found, name[x.made])
    alone[x.made] = found == 0
    return Symbols(name, x.start, alone, *(np.zeros(0, np.int64),) * 3)


def recompressed(batch: Batch, n: int, *answers: dict[int, bytes]) -> tuple[Words, Symbols]:
    """The symbols of a batch after as many named rounds as there are answers, and one more if that is not the last."""
    words = words_of(batch)
    x = Symbols(words.name, np.arange(len(words.name)), np.zeros(len(words.name), bool), *(np.zeros(0, np.int64),) * 3)
    for turn in range(len(RUNS)):
        x = joined(x, words, turn)
        if turn == len(answers):
            break
        x = read_names(x, words, n, answers[turn])
    return words, x


def _ladder(names: np.ndarray, seed: int, to: int) -> dict[int, np.ndarray]:
    """Names of the 1, 2, 4, ... words from every position, by naming pairs of the level before."""
    levels, width = {1: names}, 1
    while 2 * width <= to:
        x = levels[width]
        levels[2 * width] = named(x[:-width], x[width:], seed + width) if len(x) > width else x[:0]
        width *= 2
    return levels


def _piece(levels: dict[int, np.ndarray], width: int, seed: int) -> np.ndarray:
    """Names of the `width` words from every position, put together from the ladder."""
    parts, at = [], 0
    for level in sorted(levels, reverse=True):
        if width - at >= level:
            parts.append((at, levels[level]))
            at += level
    total = max(0, len(levels[1]) - width + 1)
    out = parts[0][1][:total]
    for at, x in parts[1:]:
        out = named(out, x[at : at + total], seed + at)
    return out


def phrases(words: Words, x: Symbols, levels: dict[int, np.ndarray]) -> np.ndarray:
    """For each word the name of the phrase of the border there, the largest number where there is no border."""
    total = len(words.name)
    value = np.full(total, _NONE, dtype=np.uint64)
    piece = _piece(levels, LONG, 200)
    border = x.start[x.start < len(piece)]
    if not len(border):
        return value
    end = np.append(x.start[1:], total)
    # the symbols from each border that end within REACH words, as a sum that no other sequence has (but by chance)
    stop = np.searchsorted(end, border + REACH, side="right")
    power = np.cumprod(np.full(len(x.name) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    back = np.cumprod(np.full(len(x.name) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(x.name, 60) * power[:-1])])
    number = np.arange(len(border))
    value[border] = named((sums[stop] - sums[number]) * back[number], piece[border], 61)
    return value


def window_keys(words: Words, x: Symbols) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The starts of all windows that may be repeated, the phrase each is known by, and the ladder of names."""
    levels = _ladder(words.name, 100, 32)
    total = len(words.name)
    starts = np.flatnonzero(np.arange(total) + WINDOW <= np.repeat(np.cumsum(words.counts), words.counts))
    if not len(starts):
        return starts, np.zeros(0, np.uint64), levels
    keys = sliding_least(phrases(words, x, levels), SPAN)[starts + EDGE]
    # symbols of one document only between the borders that are a window's own: by the word after its last one, where it begins
    end = np.append(x.start[1:], total)
    latest = np.full(total + 1, -1, dtype=np.int64)
    latest[end[x.alone]] = x.start[x.alone]
    latest = np.maximum.accumulate(latest)
    maybe = latest[starts + WINDOW - EDGE] < starts + EDGE
    return starts[maybe], keys[maybe], levels


def window_names(levels: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """96-bit names of the windows at `at`."""
    a = _piece(levels, WINDOW, 300)[at]
    second = _ladder(mix(levels[1], 5), 400, 32)
    out = np.zeros(len(at), dtype=_NAME)
    out["a"], out["b"] = a, (_piece(second, WINDOW, 500)[at] >> np.uint64(32)).astype(np.uint32)
    return out


def several(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and if it stands in more than one document of the batch."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    change = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    keys, doc = keys[change], doc[change]
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def send_keys(keys: np.ndarray, doc: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """A batch's keys, 64 bits each: the lowest says if the batch has the key in more than one document."""
    unique, many = several(keys & ~np.uint64(1), doc)
    for bucket, part in by_bucket(bucket_of(unique, n)):
        yield bucket, (unique[part] | many[part].astype(np.uint64)).astype("<u8").tobytes()


def compare_keys(lists: list[bytes], _bucket: int) -> list[bytes]:
    """For each list a bit per key: does it stand in more than one document?"""
    cuts = np.cumsum([len(x) // 8 for x in lists])[:-1]
    entries = np.frombuffer(b"".join(lists), "<u8")
    unique, at, n = np.unique(entries & ~np.uint64(1), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[at[(entries & np.uint64(1)).astype(bool)]] = True
    return [np.packbits(x).tobytes() for x in np.split(shared[at], cuts)]


def read_bits(bucket: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The answer bit of each of a batch's entries, given the bucket of each."""
    out = np.zeros(len(bucket), dtype=bool)
    for b, part in by_bucket(bucket):
        if (answer := answers.get(b)) is not None:
            out[part] = np.unpackbits(np.frombuffer(answer, np.uint8), count=len(part)).astype(bool)
    return out


def shared_keys(keys: np.ndarray, doc: np.ndarray, n: int, answers: dict[int, bytes]) -> np.ndarray:
    """True for each window whose key stands in more than one document of the corpus."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    keys = keys & ~np.uint64(1)
    unique, _ = several(keys, doc)
    return read_bits(bucket_of(unique, n), answers)[np.searchsorted(unique, keys)]


def first_docs(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name once, in order, the smallest id it has, and where each of `names` is among them."""
    order = np.lexsort((names["b"], names["a"]))
    ordered = names[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    where = np.empty(len(names), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
    return ordered[first], least, where


def send_names(names: np.ndarray, ids: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """A batch's window names, each with the smallest id it has there."""
    unique, least, _ = first_docs(names, ids)
    for bucket, part in by_bucket(bucket_of(unique["a"], n)):
        # columns one after another: alike bytes stand together and compress
        yield bucket, unique["a"][part].tobytes() + unique["b"][part].tobytes() + least[part].astype("<i8").tobytes()


def compare_names(lists: list[bytes], _bucket: int) -> list[bytes]:
    """For each list a bit per name: does an earlier document, of any batch, have it?"""
    sizes = [len(x) // 20 for x in lists]
    total = sum(sizes)
    names, ids = np.zeros(total, dtype=_NAME), np.zeros(total, dtype=np.int64)
    at = 0
    for data, k in zip(lists, sizes):
        names["a"][at : at + k] = np.frombuffer(data, "<u8", k)
        names["b"][at : at + k] = np.frombuffer(data, "<u4", k, 8 * k)
        ids[at : at + k] = np.frombuffer(data, "<i8", k, 12 * k)
        at += k
    _, least, where = first_docs(names, ids)
    found = np.split(least[where] < ids, np.cumsum(sizes)[:-1])
    return [np.packbits(x).tobytes() for x in found]


def repeated_names(names: np.ndarray, ids: np.ndarray, n: int, answers: dict[int, bytes]) -> np.ndarray:
    """True for each window that a document with a smaller id has too."""
    if not len(names):
        return np.zeros(0, dtype=bool)
    unique, least, where = first_docs(names, ids)
    return read_bits(bucket_of(unique["a"], n), answers)[where] | (least[where] < ids)


def kept_texts(batch: Batch, words: Words, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words that stay, joined by one space in each document, all documents one after another; and the bytes of each."""
    stay = np.flatnonzero(~gone)
    doc = words.doc[stay]
    later = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(stay) else np.zeros(0, bool)
    begin = words.start[stay] - later  # the byte before a later word is white space
    data = np.frombuffer(batch.body, dtype=np.uint8).copy()
    data[begin[later]] = 32
    inside = covered_by(begin, words.end[stay], len(data))
    sizes = np.bincount(doc, words.end[stay] - begin, minlength=len(batch.sizes)).astype(np.int64)
    return data[inside].tobytes(), sizes


def covered_by(begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """True at each position in one of the ranges begin .. end."""
    change = np.bincount(begin, minlength=length + 1) - np.bincount(end, minlength=length + 1)
    return np.cumsum(change)[:length] > 0


def removed_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """Per row of docs: id_col, n_words, n_removed and kept (the words that stay, joined by one space); if keyed, also text_md5."""
    corpus = pack(docs, id_col, text_col)
    n = bucket_count(corpus)

    def pairs(batch: Batch, *names: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        words, x = recompressed(batch, n, *names)
        yield from send_pairs(x, words, n)

    def keys(batch: Batch, *names: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        words, x = recompressed(batch, n, *names)
        starts, found, _ = window_keys(words, x)
        yield from send_keys(found, words.doc[starts], n)

    def candidates(batch: Batch, *names_and_shared: dict[int, bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words, and starts, names and ids of the windows whose phrase several documents have."""
        *names, shared = names_and_shared
        words, x = recompressed(batch, n, *names)
        starts, found, levels = window_keys(words, x)
        starts = starts[shared_keys(found, words.doc[starts], n, shared)]
        return words, starts, window_names(levels, starts), batch.ids[words.doc[starts]]

    def windows(batch: Batch, *known: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        _, _, names, ids = candidates(batch, *known)
        yield from send_names(names, ids, n)

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (*known, earlier) in batches_of(source, *rounds, "shared", "earlier"):
            words, starts, names, ids = candidates(batch, *known)
            gone = covered(starts[repeated_names(names, ids, n, earlier)], WINDOW, len(words.name))
            body, sizes = kept_texts(batch, words, gone)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            texts = [body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.ids, pa.int64(), mask=batch.ids == NO_ID),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(np.bincount(words.doc, gone, minlength=len(sizes)).astype(np.int64)),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    *([pa.array([hashlib.md5(t).hexdigest() for t in batch.texts()], pa.string())] if keyed else []),
                ],
                names=[id_col, "n_words", "n_removed", "kept", *(["text_md5"] if keyed else [])],
            )

    rounds: tuple[str, ...] = ()
    for turn in range(len(RUNS)):
        corpus = ask(corpus, rounds, pairs, name_pairs(turn), f"names{turn}")
        rounds = (*rounds, f"names{turn}")
    corpus = ask(corpus, rounds, keys, compare_keys, "shared")
    corpus = ask(corpus, (*rounds, "shared"), windows, compare_names, "earlier")
    return corpus.mapInArrow(kept, f"`{id_col}` long, n_words long, n_removed long, kept string" + ", text_md5 string" * keyed)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words taken out of text_col; texts without any stay as they are, white space included.

    What is taken out of a row follows from its id and its text, so shortened texts come back by both: null ids and ids of
    several texts included.
    """
    id_, md5, kept = (spare(docs, name) for name in ("cut_id", "cut_md5", "cut_text"))
    cut = removed_words(docs, id_col=id_col, text_col=text_col, keyed=True).where("n_removed > 0")
    cut = cut.select(F.col(id_col).alias(id_), F.col("text_md5").alias(md5), F.col("kept").alias(kept))
    same = docs[id_col].cast("long").eqNullSafe(F.col(id_)) & (F.md5(docs[text_col].cast("binary")) == F.col(md5))
    joined = docs.join(cut.dropDuplicates([id_, md5]), same, "left")
    return joined.withColumn(text_col, F.coalesce(F.col(kept), F.col(text_col))).select(docs.columns)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM d, unnest(range(1, greatest(len(w) - 48, 1))) AS r(i) WHERE len(w) >= 50),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, k FROM g JOIN m USING (h), unnest(range(i, i + 50)) AS r(k) WHERE first < doc_id),
r AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
