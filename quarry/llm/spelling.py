"""Spelling variants of the corpus's words, found by pivotal grams.

Texts are scanned for words and their occurrences counted (per task first, then by word). Near words differ by one inserted, deleted
or replaced code point. Bigrams have one order, rare ones first. A word's prefix are its three first bigrams in that order (and all
others equal to the third); its pivots are two of them that share no code point, the pair of least total rank, chosen by
dynamic programming over places. One edit leaves one of two disjoint bigrams whole. If the last prefix gram of r does not come
after that of s, that pivot of r is in the prefix of s, and else it is the other way round; so pivots of all words are matched with
prefixes of all words.

A pivot that is left whole stands at the same place in both words if the edit is to its right, and equally far from both ends if it
is to its left (position limits). The side without the edit is then equal in both words, and on the other side the edit leaves one
of two halves whole. Pivot, side, lengths and the equal half together are the key by which pivots and prefixes meet, so a frequent
bigram is as many keys as there are words around it. Pairs that meet are compared by their code points.

Defined results: a null text has no words, a null document id is empty in the hash that breaks words; repeated rows count each;
texts and words of any length are taken whole; a table without words has no rows. A word that has no near word has no form and is
its own root; ties are settled by code points. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

#: Code points and occurrences of a word at least; how many times as frequent its form is at least.
MIN_LENGTH, MIN_COUNT, FORM_TIMES = 6, 5, 5
#: A run loses a code point if this divides its hash.
BREAK = 199
#: Words counted by a task before they are handed on.
HELD_WORDS = 1 << 18
#: Grams of a prefix: two that an edit can destroy, and one more. So there are two disjoint ones among them.
PREFIX = 3


def broken(run: str, state: int) -> str:
    """run, without a code point if BREAK divides the CRC-32 of `<id>:<run>`. state: that of `<id>:`."""
    h = zlib.crc32(run.encode(), state)
    if h % BREAK:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: occurrences of the words of MIN_LENGTH code points and more in all texts, those that occur MIN_COUNT times and more."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")  # greedy: it starts where a run starts, and takes all of it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                body = body.as_buffer()
                if body is None:
                    continue
                text = body.to_pybytes().lower().decode("utf-8", "replace")  # lower() of bytes changes A-Z only
                state = zlib.crc32(key.as_buffer().to_pybytes() + b":")
                for run, n in Counter(runs.findall(text)).items():
                    word = broken(run, state)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("binary").alias("body"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix_and_pivots(word: str, number: dict[str, int]) -> tuple[list[int], tuple[int, int]]:
    """Places of the prefix grams and of the two pivots. number: gram -> frequency rank, unique; unknown grams come first."""
    order = sorted((number[g], i) for i, g in enumerate(grams(word)))
    last = order[min(PREFIX, len(order)) - 1][0]
    prefix = sorted(i for n, i in order if n <= last)
    weight = {i: n for n, i in order}
    one: list[tuple[int, int]] = []  # the least single pivot among the prefix grams up to here
    two: tuple[int, int, int] | None = None  # the least pair of disjoint ones
    free = 0  # prefix grams that end before the present one starts
    for i in prefix:
        while prefix[free] <= i - 2:
            free += 1
        if free:
            pair = (one[free - 1][0] + weight[i], one[free - 1][1], i)
            two = min(two, pair) if two else pair
        one.append(min((weight[i], i), one[-1]) if one else (weight[i], i))
    return prefix, two[1:]


def sides(word: str, i: int, pivot: bool) -> Iterator[tuple[str, str, int, int, int, str]]:
    """Keys of the gram at i: side of the edit, equal side with the gram, lengths of the edited side (pivot's word, other word), half, equal half."""
    for side, equal, edited in (("R", word[: i + 2], word[i + 2 :]), ("L", word[i:], word[:i])):
        own = len(edited)
        for other in (own - 1, own, own + 1):
            if other < 0:
                continue
            least = min(own, other)
            half = least // 2
            lengths = (own, other) if pivot else (other, own)
            yield side, equal, *lengths, 0, edited[:half]
            yield side, equal, *lengths, 1, edited[own - (least - half) :]


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of near words. words: word, n.

    The number of bigrams is bounded by the alphabet (90 x 90), so their frequencies are broadcast. Prefixes are not: Spark takes the
    size of the words for that of their keys, of which a word has dozens.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    frequent = words.select(F.explode(cuts).alias("g")).groupBy("g").agg(F.count("*").alias("n")).orderBy("n", "g").collect()
    number = {r["g"]: k for k, r in enumerate(frequent)}
    kind = "h long, word string, n long"

    def keyed(pivot: bool):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    hs, ws, ns = [], [], []
                    for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        prefix, pivots = prefix_and_pivots(word, number)
                        found = {xxhash.xxh64_intdigest(repr(key)) for i in (pivots if pivot else prefix) for key in sides(word, i, pivot)}
                        hs += found
                        ws += [word] * len(found)
                        ns += [n] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([h - (1 << 63) for h in hs], pa.int64()), pa.array(ws, pa.string()), pa.array(ns, pa.int64())], names=["h", "word", "n"])

        return keys

    pivots = words.select("word", "n").mapInArrow(keyed(True), kind)
    prefixes = words.select("word", "n").mapInArrow(keyed(False), kind).select("h", F.col("word").alias("near"), F.col("n").alias("near_n"))
    close = (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    pairs = pivots.join(prefixes.hint("merge"), "h").where(close).select("word", "n", "near", "near_n")
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(turned).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms lead. forms: word, form.

    Pointers double in each round. A form is FORM_TIMES as frequent as its word, so chains are short, and as few words are near
    one word (by its length) as few meet in a form. Files are compressed, so their size does not tell if rows can be broadcast.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = now.join(ahead.hint("merge"), "root", "left")
        now = stored(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(count_words(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("b"))
    rows = words.join(best.hint("merge"), "word", "left")
    has = -F.col("b.m") >= FORM_TIMES * F.col("n")
    rows = stored(rows.select("word", F.when(has, F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("b.m")).alias("form_n")), "forms")
    led = roots(rows.where("form is not null"))
    return rows.join(led.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form and root."""
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
u AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
y AS (SELECT run, n, list_transform(string_split(id || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS cps FROM u),
b AS (SELECT run, n, flatten(list_transform(cps, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END)) AS bytes FROM y),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h FROM b, k),
w0 AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM w0 WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM v),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.cut UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.cut),
f AS (SELECT word, count(*) AS n_near, min_by(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
r AS (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at, form AS next FROM r UNION ALL SELECT c.word, r.word, r.form FROM c JOIN r ON r.word = c.next)
SELECT r.word, r.form, c.at AS root, r.n, r.n_near, r.form_n FROM r JOIN c ON c.word = r.word AND c.next IS NULL
"""
