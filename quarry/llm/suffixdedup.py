"""Exact substring dedup over bytes with longest previous factors in suffix order; the first copy stays.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id.

* Candidates. Each window of 50 bytes is known by the smallest hash among its 20-byte pieces; equal windows have the same one.
  A first exchange between batches finds the hashes that stand in more than one document; all other windows are unique. Hashes
  only choose candidates, all that follows compares bytes.
* Suffix order. Neighbouring windows with the same hash form a segment. Segments go to the bucket of their hash, where all
  suffixes that begin in them are sorted, by 50 bytes and then by doc_id. The common prefixes of neighbours give, for each suffix, those with
  the previous and the next suffix of a smaller doc_id: the longer one is its longest previous factor. (Lengths count up to 50,
  the contract asks for no more, and are not followed below it.) A window is removed if its factor reaches 50.
* Frequent hashes, with HEAVY windows or more in all batches together, may stand beside different text each time. Their windows
  go out one by one, each to the bucket of a hash of its own 50 bytes, so no bucket holds more than HEAVY windows for a hash.

A batch sends equal segments once, with their smallest doc_id, so copies cost the exchange nothing; a bucket sorts equal segments
of several batches once. The number of buckets follows the input (`repeats.py`).

Defined results: null and empty texts have no bytes; rows with the same doc_id do not remove from each other; rows with a null
doc_id come after all others and do not remove from each other; a text longer than a batch is a batch of its own, read whole; an
empty table gives no rows; other columns, whatever their names, are not read. kept may end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.repeats import NO_ID, Batch, ask, batches_of, bucket_count, bucket_of, covered, mix, named, pack, sliding_least

WINDOW = 50
PIECE = 20
SPAN = WINDOW - PIECE + 1
HEAVY = 1 << 16
#: The lowest bits of a hash make room for a flag and the size of its windows in a batch, a power of two.
_SIZE_BITS = 5
_LOW = np.uint64((1 << (1 + _SIZE_BITS)) - 1)

_BYTES = mix(np.arange(256, dtype=np.uint64), 1)
_STEP = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 4: 0x165667B19E3779F9, 8: 0x27D4EB2F165667C5, 16: 0x85EBCA77C2B2AE63}


def _double(x: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * width bytes from those of width bytes."""
    out = x[:-width] * np.uint64(_STEP[width])
    out += x[width:] ^ (x[width:] >> np.uint64(29))
    return out


CHUNK = 1 << 15
#: The smallest 64-bit numbers of one byte, of two, ...
_BYTE_STEPS = np.left_shift(np.uint64(1), np.arange(0, 64, 8, dtype=np.uint64))


def window_keys(data: np.ndarray) -> np.ndarray:
    """The smallest hash of the PIECE-byte pieces of every window. Worked out chunk by chunk, to stay in the processor's cache."""
    total = max(0, len(data) - WINDOW + 1)
    out = np.empty(total, dtype=np.uint64)
    for at in range(0, total, CHUNK):
        two = _double(_BYTES[data[at : at + CHUNK + WINDOW - 1]], 1)
        four = _double(two, 2)
        sixteen = _double(_double(four, 4), 8)
        pieces = sixteen[: len(four) - 16] * np.uint64(_STEP[16])
        pieces += four[16:]
        keys = sliding_least(mix(pieces, 3), SPAN)
        out[at : at + len(keys)] = keys
    return out


class Windows:
    """The 50-byte windows of a batch as runs of neighbours of one document with the same key: start, count, key, doc."""

    def __init__(self, batch: Batch):
        self.batch = batch
        self.data = np.frombuffer(batch.body, dtype=np.uint8)
        keys = window_keys(self.data)
        ends = np.cumsum(batch.sizes)
        change = np.ones(len(keys) + 1, dtype=bool)
        change[1:-1] = keys[1:] != keys[:-1]
        for border in (ends - batch.sizes, ends - WINDOW + 1):  # where a document's windows begin, and end
            change[border[(border >= 0) & (border < len(keys))]] = True
        first = np.flatnonzero(change)
        start, count = first[:-1], np.diff(first)
        doc = np.searchsorted(ends, start, side="right")
        inside = start + WINDOW <= ends[doc] if len(start) else np.zeros(0, bool)
        self.start, self.count, self.doc = start[inside], count[inside], doc[inside]
        self.keys = keys[self.start] & ~_LOW

    def sent_keys(self, n: int) -> Iterator[tuple[int, bytes]]:
        """The batch's keys by bucket, each once; the low bits say if several documents have it, and how many windows (equal runs
        counted once)."""
        unique, many, size = self.distinct_keys()
        entry = unique | many.astype(np.uint64) | (size << np.uint64(1))
        for bucket, part in by_bucket(bucket_of(unique, n)):
            yield bucket, entry[part].astype("<u8").tobytes()

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return self.keys, np.zeros(0, bool), np.zeros(0, np.uint64)
        eight = np.ndarray(len(self.data) - 7, dtype="<u8", buffer=self.batch.body, strides=(1,))
        looks = mix(eight[self.start], 5) + self.count.astype(np.uint64)  # tells runs apart well enough to count them
        order = np.lexsort((looks, self.keys))
        keys, looks, doc, count = self.keys[order], looks[order], self.doc[order], self.count[order]
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        new = new_key | np.concatenate([[True], looks[1:] != looks[:-1]])
        first = np.flatnonzero(new_key)
        windows = np.add.reduceat(np.where(new, count, 0), first)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        return keys[first], many, np.ceil(np.log2(windows)).astype(np.uint64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def compare_keys(lists: list[bytes], _bucket: int) -> list[bytes]:
    """For each list a bit per key: does it stand in more than one document? Then a bit: has it HEAVY windows?"""
    cuts = np.cumsum([len(x) // 8 for x in lists])[:-1]
    entries = np.frombuffer(b"".join(lists), "<u8")
    keys, many = entries & ~_LOW, (entries & np.uint64(1)).astype(bool)
    size = np.left_shift(np.int64(1), ((entries & _LOW) >> np.uint64(1)).astype(np.int64))
    unique, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    shared = n > 1
    np.logical_or.at(shared, at, many)
    heavy = np.bincount(at, size, minlength=len(unique)) >= HEAVY
    return [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared[at], cuts), np.split(heavy[at], cuts))]


def equal_rows(rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 64-bit words: the row with the smallest `least` of each group of equal rows, and the group of each row.

    Rows are put in order by a hash, but only rows with the same words are one group.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = mix(rows[:, 0], 11)
    for k in range(1, rows.shape[1]):
        name = named(name, rows[:, k], 20 + 2 * k)
    order = np.lexsort((least, name))
    new = np.ones(len(order), dtype=bool)
    ordered = name[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    new[same] = (rows[order[same]] != rows[order[same - 1]]).any(axis=1)
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


def text_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The `size` bytes from each start as rows of 64-bit words, with the size as their last word."""
    width = -(-most // 8) * 8
    rows = np.zeros((len(start), width + 8), dtype=np.uint8)
    if len(start):
        padded = np.concatenate([data, np.zeros(width, np.uint8)])
        rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
        rows[:, :width][np.arange(width)[None, :] >= size[:, None]] = 0
    out = rows.view("<u8")
    out[:, -1] = size
    return out


class Candidates:
    """What a batch sends in the second exchange: distinct segments of windows with shared hashes."""

    def __init__(self, windows: Windows, n: int, shared: dict[int, bytes]):
        keys, ids = windows.keys, windows.batch.ids
        unique, _, _ = windows.distinct_keys()
        some, many = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
        for bucket, part in by_bucket(bucket_of(unique, n)):
            if (answer := shared.get(bucket)) is not None:
                bits = np.frombuffer(answer, np.uint8)
                some[part] = np.unpackbits(bits, count=len(part)).astype(bool)
                many[part] = np.unpackbits(bits[(len(part) + 7) // 8 :], count=len(part)).astype(bool)
        where = np.searchsorted(unique, keys)
        used = some[where] if len(keys) else np.zeros(0, bool)
        start, count, key, doc = windows.start[used], windows.count[used], keys[used], windows.doc[used]
        # pieces of SPAN windows at most (runs of periodic text are longer), and of one window for frequent hashes
        longest = np.where(many[where][used], 1, SPAN) if len(keys) else count
        pieces = -(-count // longest) if len(count) else count
        step = _ranges(np.zeros(len(pieces), np.int64), pieces) * np.repeat(longest, pieces)
        self.start, self.count = np.repeat(start, pieces) + step, np.minimum(np.repeat(count, pieces) - step, np.repeat(longest, pieces))
        self.id = ids[np.repeat(doc, pieces)]
        rows = text_rows(windows.data, self.start, self.count + WINDOW - 1, SPAN + WINDOW - 1)
        self.sample, self.where = equal_rows(rows, self.id)
        # the bucket: of the hash, or of the window's own bytes
        route = np.repeat(key, pieces)[self.sample]
        alone = np.repeat(longest == 1, pieces)[self.sample]
        if alone.any():
            own = rows[self.sample[alone]]
            name = own[:, 0]
            for k in range(1, own.shape[1]):
                name = named(name, own[:, k], 60 + 2 * k)
            route[alone] = name
        self.bucket = bucket_of(route, n)
        self.least = self.id[self.sample]

    def sent(self, body: bytes, n: int) -> Iterator[tuple[int, bytes]]:
        for bucket, part in by_bucket(self.bucket):
            at = self.sample[part]
            texts = [body[a : a + c + WINDOW - 1] for a, c in zip(self.start[at].tolist(), self.count[at].tolist())]
            head = self.count[at].astype(np.uint8).tobytes() + self.least[part].astype("<i8").tobytes()
            yield bucket, len(part).to_bytes(4, "little") + head + b"".join(texts)

    def removed(self, n: int, answers: dict[int, bytes]) -> np.ndarray:
        """The starts of all windows that a document with a smaller id has too."""
        count = self.count[self.sample]
        offset = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        bits = np.zeros(offset[-1], dtype=bool)
        for bucket, part in by_bucket(self.bucket):
            size = int(count[part].sum())
            bits[_ranges(offset[part], count[part])] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=size).astype(bool)
        gone = bits[_ranges(offset[self.where], self.count)] | np.repeat(self.id > self.least[self.where], self.count)
        return _ranges(self.start, self.count)[gone]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., count numbers from each first, one range after another."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(first, count)


def suffix_order(text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first WINDOW bytes and then by id, and how many bytes each shares with the one before it."""
    words = -(-WINDOW // 8)
    padded = np.concatenate([text, np.zeros(8 * words, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)[starts]
    rows[:, WINDOW:] = 0
    prefix = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((ids, *prefix.T[::-1]))
    ordered = prefix[order]
    common = np.zeros(len(order), dtype=np.int64)
    going = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(words):
        odd = ordered[1:, k] ^ ordered[:-1, k]
        common[1:] += np.where(going, 8 - np.searchsorted(_BYTE_STEPS, odd, side="right"), 0)
        going &= odd == 0
    return order, np.minimum(common, WINDOW)


def longest_previous(order: np.ndarray, common: np.ndarray, ids: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """For each suffix the longest prefix that it shares with a suffix of a smaller id: its longest previous factor.

    In suffix order it is shared with the previous or the next suffix of a smaller id. Both are found for all suffixes at once: each
    points to its neighbour, and as long as that has no smaller id, on to where the neighbour points; the common prefix with the
    suffix pointed to is the least on the way. Pointers with less than `least` in common are not followed further.
    """
    out = np.zeros(len(order), dtype=np.int64)
    for turned in (False, True):
        rank, shared = ids[order], common
        if turned:  # the next smaller one is the previous one from behind
            rank, shared = rank[::-1], np.concatenate([[0], common[:0:-1]])[: len(order)]
        to, best = np.arange(-1, len(order) - 1), shared.copy()
        while True:
            at = np.flatnonzero((to >= 0) & (best >= least))
            at = at[rank[to[at]] >= rank[at]]
            if not len(at):
                break
            best[at], to[at] = np.minimum(best[at], best[to[at]]), to[to[at]]
        best[to < 0] = 0
        found = best[::-1] if turned else best
        out[order] = np.maximum(out[order], found)
    return out


def compare(lists: list[bytes], _bucket: int) -> list[bytes]:
    """Answers the lists of one bucket with a bit for each suffix: does its longest previous factor reach WINDOW?"""
    texts, counts, ids = [], [], []
    for data in lists:
        k = int.from_bytes(data[:4], "little")
        counts.append(np.frombuffer(data, np.uint8, k, 4).astype(np.int64))
        ids.append(np.frombuffer(data, "<i8", k, 4 + k))
        texts.append(data[4 + 9 * k :])
    sizes = [int(x.sum()) for x in counts]
    count, text, every = np.concatenate(counts), np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(ids)
    size = count + WINDOW - 1
    offset = np.cumsum(size) - size
    # of equal segments only the one with the smallest id is sorted; the others are its copies
    sample, where = equal_rows(text_rows(text, offset, size, SPAN + WINDOW - 1), every)
    starts = _ranges(offset[sample], count[sample])
    owner = np.repeat(every[sample], count[sample])
    order, common = suffix_order(text, starts, owner)
    found = longest_previous(order, common, owner) >= WINDOW
    begin = np.cumsum(count[sample]) - count[sample]
    bits = found[_ranges(begin[where], count)] | np.repeat(every > every[sample][where], count)
    return [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]


def removed_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    corpus = pack(docs, id_col, text_col)
    n = bucket_count(corpus)

    def keys(batch: Batch) -> Iterator[tuple[int, bytes]]:
        yield from Windows(batch).sent_keys(n)

    def segments(batch: Batch, shared: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        yield from Candidates(Windows(batch), n, shared).sent(batch.body, n)

    def kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (shared, earlier) in batches_of(source, "shared", "earlier"):
            gone = covered(Candidates(Windows(batch), n, shared).removed(n, earlier), WINDOW, len(batch.body))
            removed, spans, texts = [], [], []
            for text, size, end in zip(batch.texts(), batch.sizes.tolist(), np.cumsum(batch.sizes).tolist()):
                mask = gone[end - size : end]
                removed.append(int(mask.sum()))
                spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
                texts.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if removed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.ids, pa.int64(), mask=batch.ids == NO_ID),
                    pa.array(batch.sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(texts, pa.binary()),
                ],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    corpus = ask(corpus, (), keys, compare_keys, "shared")
    corpus = ask(corpus, ("shared",), segments, compare, "earlier")
    return corpus.mapInArrow(kept, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
