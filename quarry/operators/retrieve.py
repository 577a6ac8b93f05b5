"""Retrieval for tables of queries: BM25, dense cosine, fusion, gates, windows of context, citation numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.index import cosine_top

RRF = 60


def top(df: DataFrame, by: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered. Spark drops the rest before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def branch_queries(queries: DataFrame, translations: DataFrame, key: str, text: str) -> DataFrame:
    """key, dense_text, sparse_text and branches. The dense branch asks the text as it is. The sparse one asks it in the corpus's
    language: its translation, or the text itself if that is in it already (own); without either only the dense branch runs.

    queries: key, text, own; translations: key, translation.
    """
    told = translations.select(key, F.nullif(F.trim("translation"), F.lit("")).alias("told"))
    sparse = F.coalesce("told", F.when(F.col("own"), F.nullif(F.trim(text), F.lit(""))))
    rows = queries.join(told, key, "left").select(key, F.col(text).alias("dense_text"), sparse.alias("sparse_text"))
    return rows.withColumn("branches", F.when(F.col("sparse_text").isNotNull(), "hybrid").otherwise("dense"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.round(dot(a, b) / (norm(a) * norm(b)), 6)


def fuse(branches: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion: query_id, key, score, rank. A branch has query_id, key and rank."""
    both = branches[0].select("query_id", "key", "rank")
    for branch in branches[1:]:
        both = both.unionByName(branch.select("query_id", "key", "rank"))
    scores = both.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return top(scores, ["query_id"], [F.desc("score"), "key"], k)


def fuse_keyed(sparse: DataFrame, dense_: DataFrame, *, last_wins: bool) -> DataFrame:
    """Fusion over a coarser key. A key that a branch holds more than once: in the sparse branch its best (or, with last_wins,
    its last) rank counts, in the dense branch all ranks add up (or its best counts)."""
    one = lambda r: 1.0 / (RRF + r)
    a = sparse.groupBy("query_id", "key").agg((F.max("rank") if last_wins else F.min("rank")).alias("bm25_rank"))
    a = a.withColumn("sparse_part", one(F.col("bm25_rank")))
    added = F.sum(one(F.col("rank"))) if last_wins else F.max(one(F.col("rank")))
    b = dense_.groupBy("query_id", "key").agg(added.alias("dense_part"), F.min("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", "key"], "full")
    score = F.coalesce("sparse_part", F.lit(0.0)) + F.coalesce("dense_part", F.lit(0.0))
    return both.select("query_id", "key", "bm25_rank", "dense_rank", F.round(score, 9).alias("score"))


def interleave(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two rankings taken in turns, each key once."""
    both = first.select("query_id", "key", "rank", F.lit(0).alias("branch")).unionByName(second.select("query_id", "key", "rank", F.lit(1).alias("branch")))
    place = both.groupBy("query_id", "key").agg(F.min(F.struct("rank", "branch")).alias("p"))
    return top(place, ["query_id"], ["p", "key"], k).select("query_id", "key", "rank")


def overlap_f1(query: Column, text: Column) -> Column:
    """The built-in reranker: F1 of distinct tokens."""
    q, t = F.array_distinct(X.tokens(query)), F.array_distinct(X.tokens(text))
    both = F.size(F.array_intersect(q, t))
    return F.round(F.when(both > 0, 2.0 * both / (F.size(q) + F.size(t))).otherwise(F.lit(0.0)), 6)


def verdict(queries: DataFrame, ranked: DataFrame, gate: Column) -> DataFrame:
    """One row a query: top_score, confident, reason. ranked: query_id, rerank_score (null if not reranked)."""
    best = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"), F.count("*").alias("n"))
    out = queries.join(best, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    confident = F.when(F.col("n") == 0, False).when(F.col("top_score").isNull(), True).otherwise(F.col("top_score") >= gate)
    reason = F.when(F.col("n") == 0, "empty").when(F.col("top_score").isNull(), "not_reranked").when(F.col("top_score") >= gate, "ok").otherwise("below_gate")
    return out.select("query_id", "n", "top_score", confident.alias("confident"), reason.alias("reason"))


def window_of(df: DataFrame, child: str, parent: str, most: int = 1200) -> Column:
    """The part of column parent around column child: the child's first 100 characters are the anchor; cuts are marked."""
    pos = F.expr(f"locate(substring({child}, 1, 100), {parent}) - 1")
    start = F.when(pos < 0, 0).otherwise(F.greatest(F.lit(0), pos - F.floor(F.lit((most - 200) / 2)).cast("int")))
    cut = F.substring(F.col(parent), start + 1, F.lit(most))
    head = F.when(start > 0, "……").otherwise("")
    tail = F.when(start + most < F.length(parent), "……").otherwise("")
    return F.when(F.length(parent) <= most, F.col(parent)).otherwise(F.concat(head, cut, tail))


def small_to_big(hits: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """The best hit of each query and parent, with the parent's window; hits without a parent pass as they are.

    hits: query_id, key, rank, parent_id, text; parents: parent_id, parent_text. A parent that is missing keeps the child.
    """
    named = F.coalesce(F.col("parent_id"), F.lit("")) != ""
    with_parent = top(hits.where(named), ["query_id", "parent_id"], ["rank"], 1, "__n").drop("__n")
    joined = with_parent.join(parents, "parent_id", "left")
    context = F.when(F.col("parent_text").isNull(), F.col("text")).otherwise(window_of(joined, "text", "parent_text"))
    joined = joined.select("query_id", "key", "rank", context.alias("context"))
    rest = hits.where(~named).select("query_id", "key", "rank", F.col("text").alias("context"))
    return joined.unionByName(rest).where(F.col("rank") <= k)


def scoped_confidence(confident: Column, reranked: Column, item_filter: Column, hits: Column) -> Column:
    """Null where nothing was reranked. Hits from the one item that was named count as confident even below the gate."""
    return F.when(reranked, F.when(item_filter & (hits > 0), True).otherwise(confident))


def keeps_references(intent: Column) -> Column:
    """Rows of reference sections only stay for questions without an intent, or about metadata."""
    return F.coalesce(intent, F.lit("")).isin("", "metadata_query")


def cap_sources(sources: DataFrame, answers: DataFrame, by: str, order: str, n: str, same: list[str], *, cap: int = 20, text: str = "text") -> DataFrame:
    """The sources under an answer, with their place. Of equal ones (in all columns of `same`, null like empty) the first stays. Numbered
    ones come first by number, the others in their order. Beyond cap, those that the answer cites ([n], [资料n], up to two digits) stay
    and the first others fill what is left; if more are cited, all of these stay. answers: by, text.
    """
    first = Window.partitionBy(by, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same]).orderBy(order)
    one = sources.withColumn("__i", F.row_number().over(first)).where("__i = 1").drop("__i")
    cites = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("\\[(?:资料)?([0-9]{1,2})\\]"), 1), lambda x: x.cast("int"))
    one = one.join(answers.select(by, cites.alias("__cites")), by, "left")
    one = one.withColumn("__cited", F.coalesce(F.array_contains("__cites", F.col(n).cast("int")), F.lit(False)))
    whole = Window.partitionBy(by)
    ordered = [F.col(n).isNull(), F.col(n), F.col(order)]
    one = one.withColumn("__all", F.count("*").over(whole)).withColumn("__kept", F.count_if("__cited").over(whole)).withColumn("__slot", F.row_number().over(Window.partitionBy(by, "__cited").orderBy(*ordered)))
    kept = one.where((F.col("__all") <= cap) | F.col("__cited") | (F.col("__slot") <= cap - F.col("__kept")))
    out = kept.withColumn("place", F.row_number().over(whole.orderBy(*ordered)))
    return out.select(*sources.columns, "place", F.col("__cited").alias("cited"))


def citation_numbers(uses: DataFrame) -> DataFrame:
    """uses: thread, ord, source. Sources are numbered by first use within the thread, without gaps."""
    first = uses.groupBy("thread", "source").agg(F.min("ord").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("thread").orderBy("first", "source")))


def hyperplanes(bits: int, width: int, seed: int) -> list[list[float]]:
    """Random directions, the same for a seed."""
    return np.random.default_rng(seed).standard_normal((bits, width)).round(6).tolist()


def band_signs(width: int, bands: int, bits: int, seed: int):
    """A function of vectors (rows of a matrix): for each band, the signs along the band's directions as one integer."""
    planes = np.array(hyperplanes(bands * bits, width, seed)).T
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= 8 * np.dtype(t).itemsize)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return lambda v: ((v @ planes >= 0).reshape(len(v), bands, bits) * weights).sum(axis=2).astype(kind)


def dense_lsh(queries: DataFrame, vectors: DataFrame, *, key: str, vector: str, width: int, k: int, bands: int = 32, bits: int = 5, seed: int = 3) -> DataFrame:
    """Approximate cosine top k: vectors that share one band of signs with the query are scored exactly.

    A band of few bits holds a fixed share of all vectors, so pairs grow as queries x vectors: they are compared within the tasks, and
    only the best of each task are rows. Vectors that have no cosine (null, of length zero, with a null or NaN) take no part.
    """
    codes = band_signs(width, bands, bits, seed)
    return cosine_top(queries, vectors, query_key=key, query_vector=vector, key=key, vector=vector, k=k, codes=codes)


#: How a listed source begins, and the labels of its fields.
SOURCE_START = "(?m)(?=^(?:\\d+\\.\\s*文献编号：|资料\\d+\\b))"
SOURCE_FIELDS = {"item_id": "文献编号", "title": "标题", "source_file": "来源文件", "location": "位置"}


def source_blocks(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each source listed in column text: block_no, n (its number, if it has one) and its labelled fields."""
    blocks = F.filter(F.transform(F.split(F.col(text), SOURCE_START), lambda b: F.trim(b)), lambda b: b != "")
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(blocks).alias("block_no", "block"))
    fields = {name: F.trim(F.regexp_extract("block", f"(?m)^\\s*(?:\\d+\\.\\s*)?{label}：(.*)$", 1)) for name, label in SOURCE_FIELDS.items()}
    rows = rows.withColumn("n", F.expr("try_cast(nullif(regexp_extract(block, '^资料(\\\\d+)', 1), '') as long)"))
    rows = rows.select("*", *[c.alias(name) for name, c in fields.items()]).drop("block")
    return rows.where("title <> '' or item_id <> '' or source_file <> ''")


#: What a request's text is split by before it is a key: white space of any script.
SPACES = r"[\t-\r\x1c- \x{85}\p{Z}]+"


def request_key(text: Column, item: Column, min_score: Column, top_k: Column, revision: Column, include_reference: Column) -> Column:
    """The key under which a result may be used again: whatever changes the result is part of it, the spacing of the text is not.

    Letter case and punctuation stay, as another question may differ in them alone. Null parts are empty ones, and so is a top_k of 0;
    scores count to four places.
    """
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    number = F.when(F.coalesce(top_k, F.lit(0)) == 0, "").otherwise(top_k.cast("string"))
    flag = F.when(include_reference, "True").when(~include_reference, "False")
    parts = [folded, item, F.format_string("%.4f", min_score), number, revision.cast("string"), flag]
    parts[2] = F.when(min_score.isNotNull(), parts[2])
    return F.sha2(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\x1f"), 256)
