"""BPE encoding and decoding by prefix-sharing trie traversal.

Spark deals the texts out; each task keeps a bounded table of the white-space chunks it has met. The new words of a slice are
inserted into a trie, and a depth-first walk gives every prefix its last token: the one token t ending the prefix for which
(last token of the prefix before t, t) is a pair that BPE leaves as it is. A prefix shared by many words is worked out once,
and a word's encoding is read off by following last tokens back from its end.

Works for word-level BPE files of the tokenizers library: NFC, white-space folding and lower-casing, byte-level symbols, an
end-of-word suffix, no decoder (decoding joins the token strings with one space). Special tokens in a text are recognised
before normalisation, as the library does.

Defined results: a null text is an empty one and gives no ids and the empty string; bytes that are not UTF-8 count as the replacement
character; repeated rows are encoded row by row, null ids too; very long texts are encoded whole, one at a time; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, table

#: Chunks kept by a task before its table is emptied: a bound on memory only.
MAX_CHUNKS = 250_000
#: Pairs of tokens whose validity a task remembers before it forgets them.
MAX_PAIRS = 300_000

#: White space of the tokenizer's pattern engine (the Unicode property).
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: str.split() also splits at these, which the tokenizer keeps.
_SPLIT_TOO = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def newer_characters(vocab: str) -> dict[str, tuple[str, bool]]:
    """Characters that Python's Unicode tables lack: how the tokenizer lower-cases them, and if they are letters to it.

    The pattern module may know more letters than the tokenizer, and Python fewer, so the tokenizer itself is asked, once.
    """
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    normalizer = Tokenizer.from_file(vocab).normalizer
    planes = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", planes) if unicodedata.category(c) == "Cn"]
    letters = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(new))
    known = {c for piece, _ in letters for c in piece}
    return {c: (normalizer.normalize_str(c), c in known) for c in new}


class TrieBPE:
    """Encodes words by one depth-first walk over the trie of the words given together.

    Inside, a byte is one character, and a byte at a word's end is that character plus SHIFT; tokens are strings of these.
    """

    SHIFT = 0x1000

    def __init__(self, config: dict, newer: dict[str, tuple[str, bool]] | None = None):
        model = config["model"]
        self.newer = newer or {}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte = {symbol: chr(b) for b, symbol in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self._inner(left), self._inner(right)] = rank
        self.ids = {self._inner(s): i for s, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: by token: the tokens that may stand before it ("" for none), as far as they have been asked for
        self.before: dict[str, dict[str, bool]] = {token: {} for token in self.ids}
        self.pairs = 0
        #: by token: its id packed, and its string
        self.parts = {t: (array("I", [i]).tobytes(), self.strings[i].encode()) for t, i in self.ids.items()}
        #: by white-space chunk: its ids packed, and their decoding; then the tables of before
        self.packed: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _inner(self, token: str) -> str:
        end = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        inner = "".join([self.byte[c] for c in (token[: -len(self.suffix)] if end else token)])
        return inner[:-1] + chr(ord(inner[-1]) + self.SHIFT) if end else inner

    def _word(self, piece: str) -> str:
        """The base symbols of a pre-token, its last one marked as a word's end."""
        s = piece.encode().decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + self.SHIFT) if self.suffix else s

    def merged(self, symbols: str) -> list[str]:
        """Plain BPE: again and again the leftmost pair of the lowest rank is merged. For short strings: pairs of tokens."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """True if BPE of left + right is just these two tokens (left empty: if right is a token that BPE makes)."""
        if self.pairs > MAX_PAIRS:
            for known in self.before.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.before[right][left] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """The tokens of each word (a string of base symbols).

        The sorted words are the trie laid out depth first: the prefix that a word shares with the one before it is the path
        that the walk still stands on, so only the symbols below it are visited. last[d] is the last token of the path's
        first d symbols. Just one token that ends the path fits after the prefix before it, in whatever order they are tried.
        """
        out: dict[str, list[int]] = {}
        before, fits, longest = self.before, self._fits, self.longest
        path, last = "", [""]
        for word in sorted(words):
            depth, most = 0, min(len(path), len(word))
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :]
            for d in range(depth + 1, len(word) + 1):
                grown = len(last[d - 1]) + 1
                token = word[d - grown : d] if d > 1 else word[:1]
                known = before.get(token)
                if known is not None:
                    left = last[d - grown] if d > 1 else ""
                    good = known.get(left)
                    if good or (good is None and fits(left, token)):
                        last.append(token)
                        continue
                for n in range(1, min(longest, d) + 1):
                    token = word[d - n : d]
                    known = before.get(token)
                    if known is not None:
                        left = last[d - n]
                        good = known.get(left)
                        if good or (good is None and fits(left, token)):
                            break
                last.append(token)
            path = word
            tokens, at = [], len(word)
            while at:
                token = last[at]
                tokens.append(token)
                at -= len(token)
            out[word] = tokens[::-1]
        return out

    def _pieces(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a white-space chunk, special tokens as their ids."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        parts = self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                shape = part
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    shape = part
                    if not self.newer.keys().isdisjoint(part):
                        as_is = [self.newer.get(c, (c, True)) for c in part]
                        part = "".join([c for c, _ in as_is])
                        shape = "".join([c if letter else "\u2603" * len(c) for c, letter in as_is])
                part, shape = part.lower(), shape.lower()
                if shape.isalpha():
                    out.append(part)
                else:
                    out += self.pattern.findall(part) if shape == part else [part[m.start() : m.end()] for m in self.pattern.finditer(shape)]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Adds the encodings of new chunks to the tables."""
        pieces = {chunk: self._pieces(chunk) for chunk in chunks}
        forms = {p: self._word(p) for ps in pieces.values() for p in ps if isinstance(p, str)}
        tokens = self.encode_words(set(forms.values()))
        parts = self.parts
        for chunk, ps in pieces.items():
            found = []
            for p in ps:
                if isinstance(p, int):
                    found.append((array("I", [p]).tobytes(), self.strings[p].encode()))
                else:
                    found += [parts[t] for t in tokens[forms[p]]]
            self.packed[chunk] = b"".join([x for x, _ in found])
            self.decoded[chunk] = b" ".join([x for _, x in found])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Per text: the ids as little-endian 32-bit integers, and their decoding in UTF-8."""
        split = [_SPACE.split(t) if _SPLIT_TOO.search(t) else t.split() for t in texts]
        every = set(chain.from_iterable(split))
        new = every.difference(self.packed)
        if len(new) + len(self.packed) > MAX_CHUNKS:  # the tables of before are kept until the next time
            self.older, self.packed, self.decoded, new = (self.packed, self.decoded), {}, {}, every
        if self.older[0]:
            for chunk in new.intersection(self.older[0]):
                self.packed[chunk], self.decoded[chunk] = self.older[0][chunk], self.older[1][chunk]
                new.discard(chunk)
        self.learn(new)
        packed, decoded = self.packed.__getitem__, self.decoded.__getitem__
        for chunks in split:
            yield b"".join(map(packed, chunks)), b" ".join(filter(None, map(decoded, chunks)))


#: One coder for each vocabulary in a worker process: later tasks of the worker start with what earlier ones have learnt.
_CODERS: dict[int, TrieBPE] = {}


def _coder(config: str, newer: dict[str, tuple[str, bool]]) -> TrieBPE:
    key = hash(config)
    if key not in _CODERS:
        _CODERS[key] = TrieBPE(json.loads(config), newer)
    return _CODERS[key]


def encode(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_tokens, ids (packed little-endian unsigned 32-bit integers) and decoded (text of the ids)."""
    with open(vocab, encoding="utf-8") as f:  # a file of the tokenizer library on this machine, not an input
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), newer_characters(vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(*shared.value)
        for batch in slices(batches, "body", 2 << 20):
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("body").to_pylist()]
            coded = list(bpe.encode(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                    pa.array([ids for ids, _ in coded], pa.binary()),
                    pa.array([text for _, text in coded], pa.binary()).cast(pa.string()),
                ],
                names=[id_col, "n_tokens", "ids", "decoded"],
            )
        bpe.older = {}, {}  # what stays in the worker for its next task is one table

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, vocab: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the token strings of the packed ids, joined by one space (null ids: empty)."""
    with open(vocab, encoding="utf-8") as f:
        config = json.load(f)
    strings = {i: s for s, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
    shared = encoded.sparkSession.sparkContext.broadcast(strings)

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda b: " ".join([shared.value[i] for i in array("I", bytes(b))]) if b is not None else "")

    return encoded.withColumn("decoded", text_of(ids_col))


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, vocab: str | None = None) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), vocab or default_vocab())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )
