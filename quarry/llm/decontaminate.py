"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are built into one generalised suffix automaton per bounded block of items. Training
documents stream through it word by word; at each word the automaton holds the longest suffix of the document read so far
that occurs in some item. Wherever that length reaches the window, the window's words are hit.

The benchmark is cut into blocks of at most `block_words` words and BLOCK_BYTES bytes (or one item), so an automaton never
outgrows a worker, which builds that of a block once. One block is one narrow pass over the documents. With several, the documents
are written to the shared folder with a number for each row, and so are the hits of each block before the next one leaves its table:
no more than two are on the driver at a time. The spans are merged by the rows' numbers.

`decontaminate` drops documents at or above the coverage limit. In all others it cuts out the hit spans of at least `least_span`
words (one window, so that a short item like a single common word is not cut out of prose). A cut text is not searched again.

Defined results: null or wordless texts have no words and no hits; items without words match nothing; an item with a null
id still hits but is not counted or listed; repeated documents are judged row by row; very long texts are read whole, one at a
time; empty tables give no rows and no hits; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import slices, stored, table

WINDOW = 13
#: Words of benchmark text in one automaton. A bound on memory, not on work: further items go to further blocks.
BLOCK_WORDS = 400_000
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns every ASCII byte that is neither a digit nor a letter into a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(body: bytes | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text after A-Z are lower-cased."""
    return body.translate(_FOLD).split() if body else []


class SuffixAutomaton:
    """Every substring of every item, as words. `items` is a list of (item id or None, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(items)

    def _new(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state for (p's longest string + word), split from the state p leads to if that one also holds longer strings."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def _mark(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        """Which items own each window-long string and each whole short item, by the state that holds the string."""
        n, w = len(self.length), self.window
        windows: dict[int, set] = {}
        shorts: dict[int, dict[int, set]] = {}
        for name, words in items:
            v = 0
            for i, word in enumerate(words):
                v = self.step[v][word]
                while self.length[self.link[v]] >= w:
                    v = self.link[v]
                if i + 1 >= w:
                    windows.setdefault(v, set()).add(name)
            if len(words) < w:
                shorts.setdefault(v, {}).setdefault(len(words), set()).add(name)
        #: per state: the items of its window-long suffix, and the (length, items) of short items among its suffixes
        self.found: list[set | None] = [None] * n
        self.short: list[tuple | None] = [None] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= w:
                self.found[v] = self.found[up] if self.length[up] >= w else windows.get(v)
            own = tuple(sorted(shorts.get(v, {}).items()))
            self.short[v] = ((self.short[up] or ()) + own) or None

    def scan(self, words: list[bytes]) -> tuple[bytearray, set]:
        """A mark for each word (1: hit) and the items that have a window in the words."""
        step, link, length, found, short, w = self.step, self.link, self.length, self.found, self.short, self.window
        marks, items = bytearray(len(words)), set()
        v = size = 0
        for i, word in enumerate(words):
            to = step[v].get(word)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = step[v].get(word)
            if to is None:
                size = 0
                continue
            v = to
            size += 1
            if size >= w:
                marks[i - w + 1 : i + 1] = b"\x01" * w
                items |= found[v]
            if short[v]:
                for n, names in short[v]:
                    if n <= size:
                        marks[i - n + 1 : i + 1] = b"\x01" * n
                        items |= names
        return marks, items


def spans_of(marks: bytearray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as (first, one past the last)."""
    out, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        out.append((at, end))
        at = marks.find(1, end)
    return out


#: The automaton that a worker has built last, by the number of its block.
_BUILT: dict[str, SuffixAutomaton] = {}
_HITS = "__n_words long, __spans array<struct<first:int,last:int>>, __items array<string>"


def _hits_of_block(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, least_span: int | None = None) -> DataFrame:
    """docs: __body and other columns. The other columns with the hit spans of one block of items, and with least_span the text
    without the spans that long (__cut; null where there is none), cut here so that no second Python process is needed."""
    shared, number = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    names = [c for c in docs.columns if c != "__body"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = SuffixAutomaton([(name, words_of(body)) for name, body in shared.value], window)
        automaton = _BUILT[number]
        for batch in slices(batches, "__body"):
            rows: dict[str, list] = {"n_words": [], "spans": [], "items": [], "cut": []}
            for body in batch.column("__body"):
                words = words_of(body.as_py())
                marks, found = automaton.scan(words)
                rows["n_words"].append(len(words))
                rows["spans"].append([{"first": a, "last": b} for a, b in spans_of(marks)])
                rows["items"].append(sorted(n for n in found if n is not None))
                long = [s for s in spans_of(marks) if least_span and s[1] - s[0] >= least_span]
                rows["cut"].append(without_spans(body.as_py(), long) if long else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in names],
                    pa.array(rows["n_words"], pa.int64()),
                    pa.array(rows["spans"], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(rows["items"], pa.list_(pa.string())),
                    *([pa.array(rows["cut"], pa.binary())] if least_span else []),
                ],
                names=[*names, "__n_words", "__spans", "__items", *(["__cut"] if least_span else [])],
            )

    schema = docs.drop("__body").schema
    for field in StructType.fromDDL(_HITS + ", __cut binary" * bool(least_span)):
        schema = StructType([*schema, field])
    return docs.mapInArrow(scan, schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in blocks of at most block_words words and BLOCK_BYTES bytes (or one item), one after the other."""
    block, total, size = [], 0, 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("body"))
    for row in rows.toLocalIterator():
        n = len(words_of(row.body))
        if n and block and (total + n > block_words or size + len(row.body) > BLOCK_BYTES):
            yield block
            block, total, size = [], 0, 0
        if n:
            block.append((row.name, bytes(row.body)))
            total, size = total + n, size + len(row.body)
    yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str | Column = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = (),
    least_span: int | None = None,
) -> DataFrame:
    """Per row of docs: id_col, the columns in keep, n_words, n_hit, spans (word runs that are hit) and items (ids of items with
    a window there). With keep, the last four have names that begin with two underscores, and with least_span there is also
    __cut: the text (which has to be in keep) without the spans that long, null where there is none."""
    columns = [F.col(id_col).cast("long").alias(id_col), *[F.col(c) for c in keep]]
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    base = docs.select(*columns, text.cast("binary").alias("__body"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        hits = _hits_of_block(base, first, window, least_span)
    else:
        base = stored(base.withColumn("__at", F.monotonically_increasing_id()), "benchmark-rows")
        parts = [stored(_hits_of_block(base.select("__at", "__body"), first, window), "benchmark-hits")]
        while second is not None:
            found = _hits_of_block(base.select("__at", "__body"), second, window).where("size(__spans) > 0")
            parts.append(stored(found, "benchmark-hits"))
            second = next(blocks, None)
        hits = _merged(base.drop("__body"), parts)
        if least_span:
            long = F.filter("__spans", lambda s: s["last"] - s["first"] >= least_span)
            body = F.when(F.size(long) > 0, text.cast("binary"))  # only these texts go through Python
            hits = hits.withColumn("__cut", F.udf(lambda body, spans: without_spans(body, spans), "binary")(body, long))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    hits = hits.withColumn("__n_hit", n_hit)
    if keep:
        return hits
    return hits.select(id_col, *[F.col("__" + c).alias(c) for c in ("n_words", "n_hit", "spans", "items")])


def _merged(docs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """docs with the hits of all blocks, of which the first has every row: spans overlap between blocks, so runs are merged per row
    by a gaps-and-islands window."""
    parts = reduce(DataFrame.unionByName, blocks)
    runs = parts.select("__at", F.explode("__spans").alias("s")).select("__at", "s.first", "s.last")
    w = Window.partitionBy("__at").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(reach >= F.col("first"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("__at", "run")
    runs = runs.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = runs.groupBy("__at").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__spans"))
    per_row = parts.groupBy("__at").agg(
        F.max("__n_words").alias("__n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
    )
    empty = F.array().cast("array<struct<first:int,last:int>>")
    found = docs.join(per_row, "__at").join(spans, "__at", "left")
    return found.withColumn("__spans", F.coalesce("__spans", empty)).drop("__at")


def contaminated(n_hit, n_words):
    """The coverage limit: a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_spans(body: bytes | None, spans: list | None) -> bytes | None:
    """The text without the words first..last of each span, and without what stands between a span and the next word."""
    if body is None or not spans:
        return body
    starts = [m.start() for m in re.finditer(rb"[^ ]+", body.translate(_FOLD))] + [len(body)]
    out, at = [], 0
    for first, last in spans:
        out.append(body[at : starts[first]])
        at = starts[last]
    return b"".join([*out, body[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_span: int = WINDOW, **how
) -> DataFrame:
    """docs without the rows whose hit words exceed the coverage limit; rows below it lose their hit spans of least_span words
    and more, and keep the rest of their text as it is."""
    row = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__doc"))
    hits = benchmark_hits(row, benchmark, id_col="__row", text_col=F.col("__doc")[text_col], keep=("__doc",), least_span=least_span, **how)
    hits = hits.where(~contaminated(F.col("__n_hit"), F.col("__n_words")))
    cut = F.coalesce(F.col("__cut").cast("string"), F.col("__doc")[text_col])
    return hits.select(*[(cut if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, 13 AS n
  FROM b, unnest(range(1, greatest(len(w) - 11, 1))) AS r(i) WHERE len(w) >= 13
  UNION SELECT DISTINCT item_id, array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 1 AND 12),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
