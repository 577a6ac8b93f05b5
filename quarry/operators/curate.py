"""Dataset curation: dedup, stratified splits, hold-outs, pairing and clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.contain import blocks
from quarry.operators.index import slices
from quarry.operators.ranks import running
from quarry.sources.shared import stored


# Words that say nothing about an answer, the least length of a keyword, the share of keywords that may be missing,
# the most that a question may share with its source, and the words by which a third question refers to the first.
KEYWORD_STOPWORDS = (
    "did the and for with that this from are was were has have not but its their there which study paper research result results data "
    "method methods used using also such these those than can may more most other into been they when"
).split()
LEAST_KEYWORD, MISSING, OVERLAP, GRAM = 4, 0.34, 0.65, 5
#: Characters of the grams that a task looks for at once.
GRAM_CHARS = 1 << 22
REFERRING = "这篇|那篇|它|该文|这篇文章|此文献|前者|后者|上述|这个"


def kept_keywords(words: Column) -> Column:
    """Words worth checking an answer for: Chinese ones of two characters, others of four that are no stop words."""
    fits = lambda w: F.when(X.is_chinese(w), F.length(w) >= 2).otherwise((F.length(w) >= LEAST_KEYWORD) & ~F.lower(w).isin(KEYWORD_STOPWORDS))
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (w != "") & fits(w))


def missing_keywords(words: Column, source: Column) -> Column:
    lost = lambda folded: F.filter(words, lambda w: (X.normalized(w) == "") | ~F.contains(folded, X.normalized(w)))
    return F.get(F.transform(F.array(X.normalized(source)), lost), F.lit(0))  # the source is folded once, not for each word


def keywords_hold(words: Column, source: Column) -> Column:
    """True if there are keywords and at most the tolerated share of them is missing from the source."""
    n = F.size(words)
    return (n > 0) & (1 - F.size(missing_keywords(words, source)) / F.greatest(n, F.lit(1)) >= 1 - MISSING)


def three_turn_case(turns: Column, title: Column, answer: Column, words: Column, referring: str = REFERRING) -> Column:
    """True for a usable case of three questions: all of them and an answer are there, two keywords at least are kept, the first
    question has the first eight characters of the title, and the third refers back."""
    blank = F.exists(turns, lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
    named = (F.coalesce(title, F.lit("")) != "") & F.contains(F.get(turns, F.lit(0)), F.left(title, F.lit(8)))
    good = (F.size(turns) == 3) & ~blank & (F.trim(answer) != "") & (F.size(kept_keywords(words)) >= 2) & named & F.get(turns, F.lit(2)).rlike(referring)
    return F.coalesce(good, F.lit(False))


def _grams(words: Column) -> Column:
    """words is a column, not an expression, or each gram would split the text again."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, GRAM), " "))
    return F.when(n >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _trie(grams: list[tuple[bool, list[str], int]]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The words of the grams, the edges of each level of their trie (node of the level above times words, plus word, ascending: a
    node is its edge's place), and the numbers of the grams in the order of the last level. The script is the node of the first level.
    """
    terms = sorted({w for _, gram, _ in grams for w in gram})
    code = {w: i for i, w in enumerate(terms)}
    node = np.array([int(zh) for zh, _, _ in grams])
    edges = []
    for at in range(GRAM):
        every, node = np.unique(node * len(terms) + np.array([code[gram[at]] for _, gram, _ in grams]), return_inverse=True)
        edges.append(every)
    numbers = np.zeros(len(grams), np.int64)
    numbers[node] = [number for _, _, number in grams]
    return terms, edges, numbers


def _walk(batches: Iterator[pa.RecordBatch], terms: list[str], edges: list[np.ndarray], numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The key and the number of each gram of the trie that stands in a text (key, words, zh), once for each text."""
    known = pa.array(terms, pa.string())
    for batch in (part for whole in batches for part in slices(whole)):
        words = batch.column(1)
        lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        code = pc.index_in(pc.list_flatten(words), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        at = np.flatnonzero(code >= 0)
        at = at[at <= len(code) - GRAM]
        at = at[text[at] == text[at + GRAM - 1]]
        node = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[text[at]]
        for i, every in enumerate(edges):
            word = code[at + i]
            edge = node * len(terms) + word
            node = np.minimum(np.searchsorted(every, edge), len(every) - 1)
            real = (word >= 0) & (every[node] == edge)
            at, node = at[real], node[real]
        found = np.unique(text[at].astype(np.int64) * len(numbers) + node)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // len(numbers))), pa.array(numbers[found % len(numbers)])], names=["__source", "number"])


def question_overlap(questions: DataFrame, sources: DataFrame, *, key: str, question: str, source_key: str, source: str) -> DataFrame:
    """How much of each question stands in a source: key, grams (its distinct 5-grams of words, or of signs in Chinese), sources that
    share one, nearest (the source that shares most, the smallest at a tie), shared, and kept (at most 0.65 of the grams shared).

    Only sources in the question's script count. Questions of fewer than five words have no grams and are kept. The distinct grams of
    the questions are walked word by word within the tasks, so the grams of the sources are never made; a gram that stands often in a
    source counts once. Each block of GRAM_CHARS is one pass over the sources.
    """
    def words(rows: DataFrame, name: str, text: str) -> DataFrame:
        return rows.select(name, X.is_chinese(F.coalesce(F.col(text), F.lit(""))).alias("zh"), X.words_or_signs(F.col(text)).alias("w"))

    q = words(questions, key, question).select(key, "zh", _grams(F.col("w")).alias("g"))
    asked = q.select(key, "zh", F.explode("g").alias("gram"))
    distinct = stored(asked.select("zh", "gram").distinct().withColumn("number", F.monotonically_increasing_id()), "grams")
    s = words(sources, source_key, source).select(F.col(source_key).alias("__source"), "w", "zh")
    schema = s.select("__source", F.lit(0).cast("long").alias("number")).schema

    def search(block: list) -> DataFrame:
        trie = _trie([(r["zh"], r["gram"].split(" "), r["number"]) for r in block])
        return stored(s.mapInArrow(lambda batches: _walk(batches, *trie), schema), "overlaps")

    parts = [search(block) for block in blocks(distinct, "number", F.length("gram"), GRAM_CHARS)]
    hits = reduce(DataFrame.unionByName, parts) if parts else q.sparkSession.createDataFrame([], schema)
    hits = hits.distinct().withColumnRenamed("__source", "nearest").join(distinct, "number").join(asked, ["zh", "gram"])
    pairs = hits.groupBy(key, "nearest").agg(F.count("*").alias("shared"))
    best = pairs.groupBy(key).agg(F.count("*").alias("sources"), F.min(F.struct((-F.col("shared")).alias("less"), "nearest")).alias("b"))
    found = best.select(key, "sources", F.col("b.nearest").alias("nearest"), (-F.col("b.less")).alias("shared"))
    rows = q.select(key, F.size("g").alias("grams")).join(found, key, "left").fillna(0, ["sources", "shared"])
    return rows.withColumn("kept", F.col("shared") <= F.col("grams") * OVERLAP)


def capped_sample(rows: DataFrame, item: str, key: list[str], order: Column, *, cap: Column | int, n: int, used: DataFrame | None = None) -> DataFrame:
    """n rows by order, of each item at most cap; rows that an earlier sample has used take no part."""
    pool = rows if used is None else rows.join(used.select(*key), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(item).orderBy("__order", *key))
    pool = pool.withColumn("__order", order).withColumn("__place", place).where(F.col("__place") <= (F.lit(cap) if isinstance(cap, int) else cap))
    return pool.orderBy("__order", *key).limit(n).select(*rows.columns)


def variant_filter(variants: DataFrame, seeds: DataFrame, same: str, order: list[str], text: str, label_ok: Column, *, least: int = 4, most: int = 120) -> DataFrame:
    """variants with the reason why each is dropped, or `kept`: length, label, seed, repeat (a kept one before it, by order, is the same).

    same: the column by which texts are the same; label_ok: the label that a model gives the variant is that of its seed.
    """
    known = seeds.select(same).distinct().withColumn("is_seed", F.lit(True))
    rows = variants.join(known, same, "left")
    reason = F.when(~F.length(text).between(least, most), "length").when(~label_ok, "label").when(F.col("is_seed"), "seed")
    rows = rows.withColumn("reason", reason)
    first = rows.where("reason is null").groupBy(same).agg(F.min(F.struct(*order)).alias("first"))
    rows = rows.join(first, same, "left")
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.struct(*order) != F.col("first"), "repeat").otherwise("kept"))).drop("is_seed", "first")


def templated(kinds: list[tuple[str, DataFrame, str, str, list[str], Column]]) -> DataFrame:
    """Cases from templates: template, subject, question, answer. kinds: name, rows, subject column, pattern, its columns, answer."""
    out = None
    for name, rows, subject, pattern, columns, answer in kinds:
        part = rows.select(F.lit(name).alias("template"), F.col(subject).alias("subject"), F.format_string(pattern, *columns).alias("question"), answer.alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


def first_by_hash(rows: DataFrame, hash_: str, order: list[str]) -> DataFrame:
    """The first row of each hash. The smallest order key is an aggregate, so many copies combine before the shuffle."""
    rest = [c for c in rows.columns if c != hash_ and c not in order]
    best = rows.groupBy(hash_).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(hash_, *[F.col("b")[c].alias(c) for c in (*order, *rest)])


def allocate(counts: dict[str, int], n: int) -> dict[str, int]:
    """n places shared out in proportion, at least one each (if there are rows), then set right at the largest deviation."""
    total = sum(counts.values())
    if not total:
        return {}
    n = min(n, total)
    share = {k: min(c, max(1, int(n * c / total + 0.5))) for k, c in counts.items()}
    ideal = {k: n * c / total for k, c in counts.items()}
    while sum(share.values()) > n:
        able = [k for k in share if share[k] > 1] or list(share)
        share[max(able, key=lambda k: (share[k] - ideal[k], k))] -= 1
    while sum(share.values()) < n:
        share[min((k for k in share if share[k] < counts[k]), key=lambda k: (share[k] - ideal[k], k))] += 1
    return share


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows in proportion to the classes, picked by a hash of seed and key. Only the class counts reach the driver, and no
    class is sorted in one task."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    kind = rows.select(by, F.lit(0).cast("long").alias("__places")).schema
    places = rows.sparkSession.createDataFrame(list(allocate(counts, n).items()), kind)
    order = [F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))).asc(), F.col(key).asc()]
    numbered = running(rows, [by], order, rank="__n").withColumnRenamed(by, "__by")
    few = F.broadcast(places.withColumnRenamed(by, "__class"))  # one row a class
    picked = numbered.join(few, F.col("__by").eqNullSafe(F.col("__class"))).where("__n <= __places")
    return picked.withColumnRenamed("__by", by).select(*rows.columns)


def hold_out(rows: DataFrame, by: str, group: str, tenths: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(held, train): of each class the first ceil(share) rows by hash; train loses every row of a held group."""
    order = [F.sha1(F.concat(F.lit(seed), F.col(group).cast("string"))).asc(), F.col(group).asc(), *[F.col(c).asc() for c in rows.columns if c not in (by, group)]]
    numbered = running(rows, [by], order, rank="__n").withColumnRenamed(by, "__by")
    sizes = rows.groupBy(F.col(by).alias("__class")).agg(F.ceil(F.count("*") * tenths / 10).alias("__most"))  # one row a class
    held = numbered.join(F.broadcast(sizes), F.col("__by").eqNullSafe(F.col("__class"))).where("__n <= __most").withColumnRenamed("__by", by).select(*rows.columns)
    return held, rows.join(held.select(group).distinct(), group, "left_anti")


def real_first(rows: DataFrame, by: str, key: str, real: str, *, test: int, val: int, cap: int, seed: str) -> DataFrame:
    """rows with split: test, val, train or none.

    test takes real rows only, in proportion to the classes. val takes the other real ones, filled up to its size in proportion with
    made ones (or, if there are enough real ones, its share of these). train takes made rows that are left, `cap` of a class at most,
    by a hash of seed and key. Keys are unique. Only class counts reach the driver.
    """
    held = lambda df, name: df.select(key, F.lit(name).alias("split"))
    known, made = rows.where(real), rows.where(~F.col(real))
    tested = stratified(known, by, key, test, seed + "t")
    rest = known.join(tested.select(key), key, "left_anti")
    n = rest.count()
    valued = stratified(made, by, key, val - n, seed + "v") if n < val else stratified(rest, by, key, val, seed + "v")
    left = made.join(valued.select(key), key, "left_anti")
    order = [F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))).asc(), F.col(key).asc()]
    trained = running(left, [by], order, rank="__n").where(F.col("__n") <= cap)
    parts = held(tested, "test").unionByName(held(valued, "val")).unionByName(held(trained, "train"))
    if n < val:
        parts = parts.unionByName(held(rest, "val"))
    return rows.join(parts, key, "left").withColumn("split", F.coalesce("split", F.lit("none"))).select(*rows.columns, "split")


def _best(edges: DataFrame) -> DataFrame:
    """The best edge of every node: score descending, then larger ids first."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.struct("score", "a", "b").alias("e"))
    return ends.groupBy("node").agg(F.max("e").alias("e"))


def greedy_pairs(edges: DataFrame, checkpoint) -> DataFrame:
    """Pairs taken from the best score down, each node once.

    Rounds: an edge that is the best one of both its ends would be the next for either, so all such edges are taken at once and
    their nodes leave; this equals the one-by-one result because edges have a strict order. checkpoint cuts the lineage.
    """
    taken = None
    left = checkpoint(edges)
    while left.limit(1).count():
        both = _best(left).groupBy("e").agg(F.count("*").alias("ends")).where("ends = 2").select("e.a", "e.b", "e.score")
        both = checkpoint(both)
        taken = both if taken is None else taken.unionByName(both)
        used = both.select(F.explode(F.array("a", "b")).alias("n"))
        left = checkpoint(left.join(used.toDF("a"), "a", "left_anti").join(used.toDF("b"), "b", "left_anti"))
    return taken if taken is not None else edges.limit(0)


def seed_clusters(vertices: DataFrame, edges: DataFrame, size: int, checkpoint) -> DataFrame:
    """seed, member, score: clusters of at most `size`, made by the seeds in id order from what earlier seeds have left.

    vertices: v; edges: a < b, score. A seed takes its size - 1 best neighbours (score descending, then larger ids first); one
    that finds none is left alone. Rounds: an id is settled as a seed as soon as it is the smallest unresolved one among its
    neighbours and among the neighbours of each of those that it would take: no earlier seed can still take it or them. All such
    ids are settled at once and leave with their members, which equals the one-by-one result. checkpoint cuts the lineage.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w"), "score").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"), "score"))
    left = checkpoint(both.join(vertices.select("v"), "v", "left_semi").join(vertices.select(F.col("v").alias("w")), "w", "left_semi"))
    taken = None
    while left.limit(1).count():
        nodes = left.groupBy("v").agg(F.min("w").alias("least"))
        smallest = nodes.where("v < least").select("v")
        own = left.join(smallest, "v", "left_semi")
        order = Window.partitionBy("v").orderBy(F.desc("score"), F.desc("w"))
        wanted = own.withColumn("k", F.row_number().over(order)).where(F.col("k") < size)
        rivals = nodes.select(F.col("v").alias("w"), "least")
        wanted = checkpoint(wanted.join(rivals, "w"))
        seeds = wanted.groupBy("v").agg(F.min("least").alias("least")).where("v = least").select("v")
        now = checkpoint(wanted.join(seeds, "v", "left_semi").select(F.col("v").alias("seed"), F.col("w").alias("member"), "score"))
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(F.explode(F.array("seed", "member")).alias("v")).distinct()
        left = checkpoint(left.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("w")), "w", "left_anti"))
    return taken if taken is not None else edges.select(F.col("a").alias("seed"), F.col("b").alias("member"), "score").limit(0)
