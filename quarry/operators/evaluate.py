"""Scoring of retrieval and answers, rollups of results, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """hit, total and missing: of the keywords that are not blank, how many the answer says, how many there are, and those that it does
    not say."""
    folded = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.struct(k.alias("k"), X.normalized(k).alias("n")))
    once = F.struct(X.normalized(answer).alias("said"), F.filter(folded, lambda w: w["n"] != "").alias("w"))  # not for each keyword again

    def counted(c: Column) -> Column:
        holds = lambda w: F.contains(c["said"], w["n"])
        missing = F.transform(F.filter(c["w"], lambda w: ~holds(w)), lambda w: w["k"])
        return F.struct(F.size(F.filter(c["w"], holds)).alias("hit"), F.size(c["w"]).alias("total"), missing.alias("missing"))

    return F.get(F.transform(F.array(once), counted), F.lit(0))


def cross_lingual(question: Column, keywords: Column) -> Column:
    """A question in one script whose keywords are mostly words of another: more than half of the keywords that are not blank have
    letters, but are not in the question's script. Numbers count below the line only."""
    wanted = F.filter(keywords, lambda k: F.trim(k) != "")
    foreign = F.filter(wanted, lambda k: k.rlike("[A-Za-z\u4e00-\u9fff]") & ~(X.cjk_share(k) > 0.3))
    return (F.size(wanted) > 0) & (X.cjk_share(question) > 0.3) & (2 * F.size(foreign) > F.size(wanted))


def tool_path(called: Column, wanted: Column, groups: Column, intent: Column, has_history: Column, *, compare: str, metadata: str, metadata_tools: list[str]) -> Column:
    """Whether the calls of a case are right. called: array of (kind, n); wanted: array of kinds; groups: array of arrays, or null.

    Comparisons need just the wanted calls, each as often. Else no calls at all are right where the conversation may hold the answer,
    one of each group is, one of the metadata tools for such a question, or all that are wanted.
    """
    kinds = F.transform(called, lambda c: c["kind"])
    each = F.array_sort(F.transform(F.array_distinct(wanted), lambda k: F.struct(k.alias("kind"), F.size(F.filter(wanted, lambda x: x == k)).cast("long").alias("n"))))
    return (
        F.when(intent == compare, F.array_sort(called) == each)
        .when((F.size(called) == 0) & has_history, True)
        .when(F.size(groups) > 0, F.forall(groups, lambda g: F.arrays_overlap(kinds, g)))
        .when(intent == metadata, F.arrays_overlap(kinds, F.array(*map(F.lit, metadata_tools))))
        .otherwise(F.size(F.array_except(wanted, kinds)) == 0)
    )


def figure_score(answer: Column, keywords: Column, image: Column, images: Column, trap: Column) -> Column:
    """passed and figure_hit: a trap has to be refused; other questions need half of their keywords as they stand. The figure is found
    if an image of the sources has its base name (null where there is none to find, and for traps)."""
    wanted = F.filter(keywords, lambda k: k != "")
    hits = F.size(F.filter(wanted, lambda k: F.contains(answer, k)))
    passed = F.when(trap, X.refuses(answer)).otherwise((F.size(keywords) > 0) & (2 * hits >= F.size(keywords)))
    found = F.exists(images, lambda i: F.contains(i, F.substring_index(image, "/", -1)))
    return F.struct(passed.alias("passed"), F.when(~trap & (image != ""), found).alias("figure_hit"))


def lint(cases: DataFrame, key: str, rules: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """One row (key, rule) for each rule that a case breaks, and one with a null key for each that the set breaks.

    rules: conditions of a row; whole: conditions over aggregates of all rows. A null condition counts as kept.
    """
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    rows = cases.select(F.col(key).cast("string").alias("case_id"), F.explode(broken).alias("rule"))
    total = cases.agg(*[c.alias(name) for name, c in whole.items()])
    marks = F.array_compact(F.array(*[F.when(F.col(name), name) for name in whole]))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("case_id"), F.explode(marks).alias("rule")))


def keyword_hits(answer: Column, keywords: Column) -> Column:
    """The keywords that the answer says."""
    return F.filter(keywords, lambda k: X.says(answer, k))


def retrieval_score(cases: DataFrame, expected: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, chunk_hit, item_hit, hit_rank (of the first expected chunk).

    cases: case_id; expected: case_id, key, item; results: case_id, key, item, rank.
    """
    chunk = results.join(expected.select("case_id", "key"), ["case_id", "key"]).groupBy("case_id").agg(F.min("rank").alias("hit_rank"))
    item = results.join(expected.select("case_id", "item").distinct(), ["case_id", "item"]).select("case_id").distinct().withColumn("item_hit", F.lit(True))
    out = cases.join(chunk, "case_id", "left").join(item, "case_id", "left")
    return out.select("case_id", F.col("hit_rank").isNotNull().alias("chunk_hit"), F.coalesce("item_hit", F.lit(False)).alias("item_hit"), "hit_rank")


def index_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *, least: str | None = None, most: str | None = None) -> DataFrame:
    """v[min(n - 1, int(n * q))] of the sorted values of each group.

    Counted by distinct value, so no group is gathered into one list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    columns = []
    for name, q in shares.items():
        index = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))
        columns.append(F.min(F.when(F.col("upto") > index, F.col(value))).alias(name))
    if least:
        columns.append(F.min(value).alias(least))
    if most:
        columns.append(F.max(value).alias(most))
    return counts.groupBy(*by).agg(F.max("n").alias("n"), *columns)


def sweep(scores: DataFrame, score: str, positive: str, steps: int = 100) -> DataFrame:
    """cut, pass_rate (positives at or above the cut), reject_rate (others below), youden, for steps + 1 cuts.

    A histogram by the highest cut that a score reaches and running sums over it replace scores x cuts.
    """
    cut = F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.round(F.col(score) * steps, 9)))).cast("int")
    histogram = scores.groupBy(cut.alias("cut")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    every = scores.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("cut"))
    filled = every.join(histogram, "cut", "left").na.fill(0, ["p", "q"])
    down, whole = Window.orderBy(F.desc("cut")), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = filled.select("cut", F.sum("p").over(down).alias("above"), F.sum("q").over(down).alias("qa"), F.sum("p").over(whole).alias("ps"), F.sum("q").over(whole).alias("qs"))
    rates = sums.where("cut >= 0").select(
        (F.col("cut") / steps).alias("cut"), F.round(F.col("above") / F.col("ps"), 4).alias("pass_rate"), F.round((F.col("qs") - F.col("qa")) / F.col("qs"), 4).alias("reject_rate")
    )
    return rates.withColumn("youden", F.round(F.col("pass_rate") + F.col("reject_rate") - 1, 4))


def class_report(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per class: support, predicted, correct, precision, recall, f1 (null where undefined)."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("c"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("g").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0).alias("correct")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("predicted"), F.lit(0).cast("long").alias("correct")))).alias("x"))
    out = sides.where("x.class is not null").groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), F.sum("x.correct").alias("correct"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return out.select(
        "class", "support", "predicted", "correct", ratio(F.col("correct"), F.col("predicted")).alias("precision"), ratio(F.col("correct"), F.col("support")).alias("recall"),
        ratio(2 * F.col("correct"), F.when((F.col("support") > 0) & (F.col("predicted") > 0) & (F.col("correct") > 0), F.col("support") + F.col("predicted"))).alias("f1"),
    )


# The intent that a category of cases expects; the other categories expect none.
CATEGORY_INTENT = {
    "metadata": "metadata_query",
    "summary_paper": "summary_paper",
    "compare_papers": "compare_papers",
    "group_report": "group_report",
    "en_fact": "simple_qa",
    "zh_fact": "simple_qa",
    "cross_lingual": "simple_qa",
}


def case_correctness(category: Column, intent: Column, resolved: Column, expected: Column) -> tuple[Column, Column]:
    """(intent_ok, item_ok). The intent is right if it is that of the category; null without an expectation or an intent. The item that
    a coreference case resolved is right if it is an expected one; null for other cases or if none was resolved."""
    want = F.create_map(*[F.lit(x) for pair in CATEGORY_INTENT.items() for x in pair])[category]
    given = want.isNotNull() & (F.coalesce(intent, F.lit("")) != "")
    told = (category == "coreference") & resolved.isNotNull() & (resolved.cast("string") != "")
    return F.when(given, want == intent), F.when(told, F.coalesce(F.array_contains(expected, resolved), F.lit(False)))
