"""A stored forward index of a corpus, and exact best lists over it: BM25 and cosine, a block of queries against blocks of rows.

A task takes its rows in chunks. Scores of a chunk are one sparse (BM25) or dense (cosine) product, kept only where they reach what
the task has already seen k times for the query. Before a chunk is scored, a query's bound over it (weights times the largest
impacts of its words in the chunk) is compared with that floor, and queries that cannot reach it are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.contain import blocks
from quarry.sources.shared import stored

K1, B = 1.5, 0.75
#: Scores are compared after rounding to six places, so what is below a floor by less than this still counts.
SLACK = 2e-6
#: Words of the queries of one block, and numbers of one chunk of scores.
QUERY_WORDS, CHUNK = 1 << 18, 1 << 20
#: Words of documents, and meetings of such words with queries, that a task holds at once (of one document at least).
WORDS, MEETINGS = 1 << 18, 1 << 18


@dataclass
class Forward:
    """rows: key, dl, terms, tfs of every document. df: term, df. n, total: number of documents and of words."""

    rows: DataFrame
    df: DataFrame
    n: int
    total: int


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (from, to) of items whose sizes add up to `most` at most; a larger item is a run of its own."""
    upto, cuts = np.cumsum(sizes), [0]
    while cuts[-1] < len(sizes):
        done = upto[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, done + most, side="right"))))
    return list(zip(cuts, cuts[1:]))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of keys and words in slices of WORDS."""
    sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    return (batch.slice(at, to - at) for at, to in _cuts(sizes, WORDS))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and words become key, dl and the distinct words with their counts, a slice of WORDS at a time without a loop over documents."""
    for batch in (part for whole in batches for part in slices(whole)):
        words = batch.column(1)
        lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(words).dictionary_encode()
        codes = flat.indices.to_numpy()
        doc = np.repeat(np.arange(len(lengths)), lengths)
        pairs, counts = np.unique(doc * (len(flat.dictionary) + 1) + codes, return_counts=True)
        doc, code = np.divmod(pairs, len(flat.dictionary) + 1)
        offsets = pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)), pa.int32())
        terms = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(code)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), terms, tfs], names=["key", "dl", "terms", "tfs"])


def _counted(rows: DataFrame) -> DataFrame:
    """key, dl, terms and tfs of rows with key and words."""
    kind = rows.select("key", F.lit(0).cast("long").alias("dl"), F.col("words").alias("terms"), F.array(F.lit(0).cast("long")).alias("tfs")).schema
    return rows.mapInArrow(_forward, kind)


def build(docs: DataFrame, key: str, text: Column) -> Forward:
    """The index of all documents, written out. Keys are unique; a null text has no words but counts as a document."""
    rows = stored(_counted(docs.select(F.col(key).alias("key"), X.tokens(text).alias("words"))), "forward")
    df = stored(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "df")
    n, total = rows.agg(F.count("key"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return Forward(rows, df, n, int(total))


def weighted_terms(docs: DataFrame, key: str, weights: dict[str, int]) -> DataFrame:
    """key, term and tf: how often each word stands in the fields of a key, where one in a field counts by the field's whole weight.

    The words of a row are counted within its task. Only rows whose key repeats (null is a key too) meet in a shuffle.
    """
    counted = docs.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    again = stored(counted, "again")

    def terms(rows: DataFrame) -> DataFrame:
        words = F.concat(*[F.flatten(F.array_repeat(X.tokens(F.col(c).cast("string")), w)) if w > 1 else X.tokens(F.col(c).cast("string")) for c, w in weights.items()])
        rows = _counted(rows.select(F.col(key).alias("key"), words.alias("words")))
        return rows.select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("key", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))

    if again.isEmpty():
        return terms(docs)
    same = docs[key].eqNullSafe(again["again"])
    repeated = terms(docs.join(again, same, "left_semi")).groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    return terms(docs.join(again, same, "left_anti")).unionByName(repeated)


class _Best:
    """The k best scores so far of each query: rows of a chunk that may still count, and the floors."""

    def __init__(self, queries: int, k: int):
        self.k, self.top = k, np.zeros((queries, 0))

    def floors(self) -> np.ndarray:
        return self.top.min(axis=1) - SLACK if self.top.shape[1] == self.k else np.full(len(self.top), -np.inf)

    def take(self, scores: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """scores: rows x queries. Row and query numbers of the scores above `least` that are not below the floors."""
        both = np.concatenate([self.top, scores.T], axis=1)
        self.top = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :] if both.shape[1] > self.k else both
        return np.nonzero((scores > least) & (scores >= self.floors()))


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    scores = reduce(DataFrame.unionByName, parts).select("query_id", "key", F.round("score", 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meet(batches: Iterator[pa.RecordBatch], ids: pa.Array, terms: list[str], words: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, average: float, step: int, most: int) -> Iterator[pa.RecordBatch]:
    """query_id, key and score of what may be among the k best of the queries `ids`, chunk by chunk of rows of the index.

    words: number of the term, of the query and weight, by term. step, most: rows and meetings held at once. A batch is let go before
    the next one is taken.
    """
    term, query, weight = words
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    best, known = _Best(len(ids), k), pa.array(terms, pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lengths = pc.list_value_length(part.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
            code = pc.index_in(pc.list_flatten(part.column(2)), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            tf = pc.list_flatten(part.column(3)).to_numpy()
            doc = np.repeat(np.arange(len(lengths)), lengths)
            doc, tf, code = doc[code >= 0], tf[code >= 0], code[code >= 0]
            dl = part.column(1).to_numpy()[doc]
            impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
            largest = np.zeros(len(terms))
            np.maximum.at(largest, code, impact)
            able = np.bincount(query, weights=weight * largest[term], minlength=len(ids)) >= best.floors()
            open_ = able[query]  # words of queries that can still reach their floor in this chunk
            upto = np.concatenate([[0], np.cumsum(open_)])
            q, w = query[open_], weight[open_]
            lo, many = upto[start[code]], upto[start[code + 1]] - upto[start[code]]
            scores = np.zeros((len(lengths), len(ids)))
            first = np.searchsorted(doc, np.arange(len(lengths) + 1))
            for d0, d1 in _cuts(np.bincount(doc, weights=many, minlength=len(lengths)), most):
                here = slice(first[d0], first[d1])
                n, at_word = many[here], lo[here]
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at_word[row]
                cell = (doc[here][row] - d0) * len(ids) + q[pos]
                scores[d0:d1] = np.bincount(cell, weights=impact[here][row] * w[pos], minlength=(d1 - d0) * len(ids)).reshape(d1 - d0, len(ids))
            d, asked_ = best.take(scores, 0.0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked_)), part.column(0).take(pa.array(d)), pa.array(scores[d, asked_])], names=["query_id", "key", "score"])
            del part
        del batch


def bm25(queries: DataFrame, index: Forward, *, query_key: str, query_text: str, k: int, keep: DataFrame | None = None) -> DataFrame:
    """query_id, key, score and rank of the k best documents of each query; every occurrence of a query word adds.

    keep (key) restricts the documents, while the statistics stay those of the whole corpus. Queries go to the tasks in blocks of
    QUERY_WORDS words; a block is one pass over the index.
    """
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(X.tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.df, "term")
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * idf).alias("w"))).alias("words"))
    rows = index.rows if keep is None else index.rows.join(keep, "key", "left_semi")
    average = index.total / max(1, index.n)
    schema = asked.select("query_id").schema
    for field in index.rows.select("key", F.lit(0.0).alias("score")).schema:
        schema = schema.add(field)

    def score(block: list) -> DataFrame:
        terms = sorted({w["term"] for r in block for w in r["words"]})
        number = {term: i for i, term in enumerate(terms)}
        triples = sorted((number[w["term"]], q, w["w"]) for q, r in enumerate(block) for w in r["words"])
        term, query, weight = (np.array(x) for x in zip(*triples))
        ids = [r["query_id"] for r in block]
        step, most = max(16, CHUNK // len(ids)), MEETINGS
        return rows.mapInArrow(lambda batches: _meet(batches, pa.array(ids, query_type), terms, (term, query, weight), k, average, step, most), schema)

    from pyspark.sql.pandas.types import to_arrow_type

    query_type = to_arrow_type(schema["query_id"].dataType)
    parts = [score(block) for block in blocks(asked, "query_id", F.size("words"), QUERY_WORDS)]
    return _ranked(parts or [queries.sparkSession.createDataFrame([], schema)], k).where("score > 0")


def cosine_top(queries: DataFrame, vectors: DataFrame, *, query_key: str, query_vector: str, key: str, vector: str, k: int, codes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, key, score and rank by exact cosine, one matrix product for each chunk of vectors and block of queries.

    codes (vectors -> vectors x bands): only vectors that share a band's code with the query count. Pairs are never rows. Vectors that are null, have a null or NaN in them or are of length zero have no score. All have one width.
    """
    usable = lambda df, k_, v: df.select(F.col(k_).alias("id"), F.col(v).cast("array<double>").alias("v")).where("exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x))")
    asked = usable(queries, query_key, query_vector)
    rows = usable(vectors, key, vector).withColumnRenamed("id", "key")
    schema = asked.select(F.col("id").alias("query_id")).schema
    for field in rows.select("key", F.lit(0.0).alias("score")).schema:
        schema = schema.add(field)

    from pyspark.sql.pandas.types import to_arrow_type

    query_type = to_arrow_type(schema["query_id"].dataType)

    def score(block: list) -> DataFrame:
        ids, matrix = [r["id"] for r in block], np.array([r["v"] for r in block])
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        asked_codes = None if codes is None else codes(matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, step := max(16, CHUNK // max(len(ids), matrix.shape[1]))):
                    part = batch.slice(at, step)
                    v = pc.list_flatten(part.column(1)).to_numpy().reshape(part.num_rows, -1)
                    scores = (v @ matrix.T) / (np.sqrt((v * v).sum(axis=1))[:, None] * norms)
                    if codes is not None:
                        meet = np.zeros(scores.shape, bool)
                        for own, other in zip(codes(v).T, asked_codes.T):
                            meet |= own[:, None] == other
                        scores[~meet] = -np.inf
                    d, asked_ = best.take(scores, -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in asked_], query_type), part.column(0).take(pa.array(d)), pa.array(scores[d, asked_])], names=["query_id", "key", "score"])

        return rows.mapInArrow(run, schema)

    parts = [score(block) for block in blocks(asked, "id", F.size("v"), QUERY_WORDS)]
    return _ranked(parts or [queries.sparkSession.createDataFrame([], schema)], k)
