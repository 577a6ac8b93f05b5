"""Language identification with bit-sliced Bloom filters of n-grams.

Every slot of the filter is a bit mask over the learned languages; an n-gram sets its language's bit in HASHES slots, and the
AND of those slots returns all languages that contain the n-gram. A text's popcount for a language is the number of its
n-grams with that language's bit; it is corrected for the filter's false positives, (hits - n f) / (1 - f) with f the share
of set bits to the power of HASHES, and the language with the largest corrected count is taken.

Learning counts n-grams over all labelled texts as a Spark aggregation. A language keeps the n-grams that make up at least
MIN_SHARE of its n-grams, so at most 1 / MIN_SHARE per language and size reach the driver, however large the input (the labels
are languages, so they are few), and drops those that another language has 1 / FOREIGN times as often.

Defined results: `und` with score 0 if the text is null or has no letter; ties go to the language that sorts first; rows
with a null lang are not learned from; with no labelled text at all every row is `und`; repeated rows are judged row by row; very
long texts are read whole, one at a time; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, spare, table

SIZES = (3, 4)  # bytes in an n-gram of lower-cased UTF-8 text
HASHES = 2
MIN_SHARE = 1e-5
#: An n-gram this much rarer in one language than in another is taken to have come from mixed or mislabelled texts.
FOREIGN = 0.05
SLOTS_PER_GRAM = 16
SLICE = 2 << 20  # bytes of text whose n-grams are held at once: some 50 bytes of arrays for each

#: What may be a letter (Unicode category L, as str.isalpha tells): the class also has signs such as ² and Ⅷ.
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters become spaces.
_ONLY_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _plain(body: bytes | None) -> bytes:
    """Lower-cased words between single spaces, or nothing if the text has no letter."""
    text = (body or b"").decode("utf-8", "replace")
    if not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_ONLY_LETTERS).split()) + b" "


def _grams(bodies: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of all texts one after another, and the number of each text's n-grams."""
    lengths = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.uint32)
    if len(data) < size:
        return np.zeros(0, np.uint64), np.zeros(len(bodies), np.int64)
    codes = np.zeros(len(data) - size + 1, dtype=np.uint32)
    for i in range(size):
        codes |= data[i : len(codes) + i] << np.uint32(8 * i)
    ends = np.cumsum(lengths)
    inside = np.ones(len(codes) + size - 1, dtype=bool)
    for i in range(1, size):
        at = ends - i
        inside[at[(at >= 0)]] = False
    return codes[inside[: len(codes)]].astype(np.uint64), np.maximum(lengths - size + 1, 0)


@dataclass
class LanguageFilter:
    languages: list[str]
    sizes: tuple[int, ...]
    planes: dict[int, np.ndarray]  # by n-gram size: slots x words of 64 languages
    false: dict[int, np.ndarray]  # by n-gram size: each language's rate of false positives

    def _slots(self, codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        shift = np.uint64(64 - int(len(self.planes[size])).bit_length() + 1)
        for m in _MULTIPLIERS[:HASHES]:
            yield (codes * np.uint64(m)) >> shift

    def corrected(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language: corrected popcount; per text: number of n-grams."""
        total, number = np.zeros((len(bodies), len(self.languages))), np.zeros(len(bodies))
        for size in self.sizes:
            codes, n = _grams(bodies, size)
            number += n
            some = n > 0
            if not some.any():
                continue
            starts = (np.cumsum(n) - n)[some]
            masks = None
            for slots in self._slots(codes, size):
                found = self.planes[size][slots]
                masks = found if masks is None else masks & found
            for k in range(len(self.languages)):
                bits = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits = np.add.reduceat(bits.astype(np.int32), starts)
                f = self.false[size][k]
                total[some, k] += np.maximum(0, (hits - n[some] * f) / (1 - f)) if f < 1 else 0
        return total, number


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", SLICE):
            langs, bodies = batch.column("lang").to_pylist(), [_plain(b) for b in batch.column("body").to_pylist()]
            for lang in sorted(set(langs)):
                own = [b for b, x in zip(bodies, langs) if x == lang]
                for size in SIZES:
                    codes, n = np.unique(_grams(own, size)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes), pa.string()), pa.array([size] * len(codes), pa.int32()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "size", "gram", "n"],
                    )

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("body"))
    counts = rows.mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).select("lang", "size", "gram", (F.col("n") / F.col("total")).alias("share"))
    kept = shares.where(F.col("share") >= MIN_SHARE).toPandas()  # at most 1 / MIN_SHARE rows per language and size
    languages = sorted(kept["lang"].unique())
    planes, false = {}, {}
    for size in SIZES:
        own = kept[kept["size"] == size]
        own = own[own["share"] >= FOREIGN * own.groupby("gram")["share"].transform("max")]
        n = own.groupby("lang").size().max() if len(own) else 1
        plane = np.zeros((1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * n))), (len(languages) + 63) // 64 or 1), dtype=np.uint64)
        planes[size] = plane
        built = LanguageFilter(languages, SIZES, planes, false)
        fill = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            codes = own.loc[own["lang"] == lang, "gram"].to_numpy().astype(np.uint64)
            bit = np.uint64(1) << np.uint64(k % 64)
            for slots in built._slots(codes, size):
                plane[np.unique(slots), k // 64] |= bit
            fill[k] = ((plane[:, k // 64] & bit) > 0).mean()
        false[size] = fill**HASHES
    return LanguageFilter(languages, SIZES, planes, false)


def predict(
    docs: DataFrame, model: LanguageFilter, *, id_col: str = "doc_id", text_col: str | Column = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Per row of docs: id_col (and the columns in keep), the language and its score, the share of the text's n-grams found."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = [F.col(id_col)] if id_col not in keep else []
    schema = docs.select(*first, *keep).schema
    kept, body = list(schema.names), spare(docs, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, body, SLICE):
            bodies = [_plain(b) for b in batch.column(body).to_pylist()]
            total, number = model.corrected(bodies)
            langs, scores = ["und"] * len(bodies), np.zeros(len(bodies))
            if model.languages:
                best = total.argmax(axis=1)
                scores = np.clip(total[np.arange(len(bodies)), best] / np.maximum(number, 1), 0, 1)
                langs = [model.languages[k] if b else "und" for k, b in zip(best, bodies)]
            scores = np.where([x == "und" for x in langs], 0.0, scores)
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(*first, *keep, text.cast("binary").alias(body))
    return rows.mapInArrow(run, schema.add(names[0], "string").add(names[1], "double"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
