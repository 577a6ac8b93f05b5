"""Verdicts on evaluation cases by category, what runs come to, and reports on thresholds and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import evaluate as E

#: Share of a case's keywords that an answer has to say.
KEYWORDS = 0.5
#: Letters of a title by which an answer cites it.
TITLE_LETTERS = 8


def retrieval_verdict(has_results: Column, has_expected: Column, chunk_hit: Column, item_hit: Column) -> Column:
    """Chunk or item found; null where there are no results or nothing is expected."""
    return F.when(has_results & has_expected, chunk_hit | item_hit)


def keyword_verdict(answer: Column, keywords: Column) -> Column:
    """rate and passed; both null where there is no keyword to look for."""
    c = E.keyword_coverage(answer, keywords)
    rate = F.when(c["total"] > 0, c["hit"] / c["total"])
    return F.struct(rate.alias("rate"), (rate >= KEYWORDS).alias("passed"))


def cites(answer: Column, titles: Column) -> Column:
    """The answer holds the first letters of one of the titles (normalised; shorter titles do not count)."""
    head = lambda t: F.left(X.normalized(t), F.lit(TITLE_LETTERS))
    return F.exists(titles, lambda t: (F.length(head(t)) == TITLE_LETTERS) & F.contains(X.normalized(answer), head(t)))


def case_verdict(
    *, category: Column, error: Column, answer: Column, has_results: Column, has_expected: Column, retrieval: Column, values: Column, crossed: Column, cited: Column, keywords: Column
) -> Column:
    """passed and unjudged of a case.

    An error fails whatever the category. A refusal has to be said; without an answer it is not judged (and counts as passed).
    Edge cases only have to give some answer, or results where nothing is expected. Metadata needs every expected value, or without an
    answer no miss of the retrieval. All others need what can be judged of retrieval and answer: the keywords, or for a question in
    another script than its keywords either these or an expected title. If nothing can be judged, the case fails.
    """
    nothing = F.lit(None).cast("boolean")
    verdict = lambda passed, unjudged=False: F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(unjudged).alias("unjudged"))
    edge = F.coalesce(F.trim(answer) != "", F.lit(False)) | (has_results & ~has_expected)
    metadata = F.when(answer.isNull(), F.coalesce(retrieval, F.lit(True))).otherwise((F.size(values) > 0) & F.forall(values, lambda v: X.says(answer, v)))
    said = F.when(answer.isNotNull(), F.when(crossed, F.coalesce(cited, F.lit(False)) | F.coalesce(keywords["passed"], F.lit(False))).otherwise(keywords["passed"])).otherwise(nothing)
    others = F.when(retrieval.isNull() & said.isNull(), False).otherwise(F.coalesce(retrieval, F.lit(True)) & F.coalesce(said, F.lit(True)))
    return (
        F.when(error.isNotNull(), verdict(F.lit(False)))
        .when((category == "refusal") & answer.isNull(), verdict(F.lit(True), True))
        .when(category == "refusal", verdict(X.refuses(answer)))
        .when(category == "edge", verdict(edge))
        .when(category == "metadata", verdict(metadata))
        .otherwise(verdict(others))
    )


def share(condition: Column, of: Column | None = None) -> Column:
    """The share of the rows that `of` holds for (or all) for which the condition does; null if there are none."""
    value = F.when(condition, 1.0).otherwise(0.0)
    return F.round(F.avg(value if of is None else F.when(of, value)), 6)


def run_summary(results: DataFrame, run: str) -> DataFrame:
    """Per run: total, judged, pass rate of the judged, intent accuracy, mean keyword rate, hit rates of chunks and items where some are
    expected, median latency.

    results: passed, unjudged, intent_ok (or null), keyword_rate (or null), has_expected, chunk_hit, item_hit, latency_ms.
    """
    judged, expected = ~F.col("unjudged"), F.col("has_expected")
    return results.groupBy(run).agg(
        F.count("*").alias("total"), F.count_if(judged).alias("judged"), share(F.col("passed"), judged).alias("pass_rate"), share(F.col("intent_ok"), F.col("intent_ok").isNotNull()).alias("intent_accuracy"),
        F.round(F.avg("keyword_rate"), 6).alias("keyword_rate"), share(F.col("chunk_hit"), expected).alias("chunk_hit_rate"), share(F.col("item_hit"), expected).alias("item_hit_rate"),
        F.round(F.median("latency_ms"), 6).alias("median_ms"),
    )


def failures(results: DataFrame) -> DataFrame:
    """kind, case_id, detail: errors with their text, refusals that were answered although nothing is known, and failed cases with
    their reasons. A case can be in several lists.

    results: case_id, category, error, answer, passed, unjudged, retrieval, keyword_rate, intent_ok.
    """
    reasons = F.concat_ws(
        "；",
        F.when(F.col("error").isNotNull(), "error"),
        F.when(~F.col("retrieval"), "not found"),
        F.when(F.col("keyword_rate") < KEYWORDS, F.concat(F.lit("keywords "), F.format_number(F.col("keyword_rate") * 100, 0), F.lit(" %"))),
        F.when(~F.col("intent_ok"), "intent"),
    )
    failed = ~F.col("passed") & ~F.col("unjudged")
    lists = F.array(
        F.struct(F.lit("error").alias("kind"), F.col("error").isNotNull().alias("in"), F.col("error").alias("detail")),
        F.struct(F.lit("hallucinated").alias("kind"), (failed & (F.col("category") == "refusal") & F.col("error").isNull()).alias("in"), F.left("answer", F.lit(80)).alias("detail")),
        F.struct(F.lit("failed").alias("kind"), failed.alias("in"), reasons.alias("detail")),
    )
    return results.select("case_id", F.explode(F.filter(lists, lambda x: x["in"])).alias("x")).select("x.kind", "case_id", "x.detail")


def best_cut(swept: DataFrame) -> DataFrame:
    """The row of a sweep with the largest Youden index; of equal ones the smallest cut. The sweep is one row a cut."""
    best = swept.agg(F.min(F.struct((-F.col("youden")).alias("m"), "cut", "pass_rate", "reject_rate", "youden")).alias("b"))
    return best.select("b.cut", "b.pass_rate", "b.reject_rate", "b.youden").where("cut is not null")


def candidate_rates(scores: DataFrame, by: str, score: str, cuts: tuple[float, ...]) -> DataFrame:
    """Per class and candidate cut the share of scores at or above it: one aggregation, the cuts are columns until the end."""
    rates = scores.groupBy(by).agg(F.count(score).alias("n"), *[share(F.col(score) >= c, F.col(score).isNotNull()).alias(f"c{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{i}").alias("pass_rate")) for i, c in enumerate(cuts)])
    return rates.select(by, "n", F.explode(rows).alias("x")).select(by, "n", "x.cut", "x.pass_rate")


def overall(rows: DataFrame, gold: str, pred: str, latency: str) -> DataFrame:
    """One row: n, accuracy, macro_f1 over the classes that have one, mean and upper median latency."""
    n = rows.agg(F.count("*").alias("n"), share(F.coalesce(F.col(gold) == F.col(pred), F.lit(False))).alias("accuracy"), F.round(F.avg(latency), 6).alias("mean_ms"))
    macro = E.class_report(rows, gold, pred).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    middle = E.index_quantiles(rows.withColumn("__all", F.lit(1)), ["__all"], latency, {"p50_ms": 0.5}).select("p50_ms")
    return n.crossJoin(macro).crossJoin(middle).select("n", "accuracy", "macro_f1", "mean_ms", "p50_ms")  # one row each


def confusions(rows: DataFrame, gold: str, pred: str, most: int) -> DataFrame:
    """The `most` commonest wrong pairs (gold, pred): the number is the feature."""
    pairs = rows.where(F.col(gold) != F.col(pred)).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "gold", "pred").limit(most)
