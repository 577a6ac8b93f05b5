"""Queries on verdicts and reports. Cases are the passages of `benchmark`; what the documents that hold them say is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import evaluate as E
from quarry.operators import verdicts as V
from quarry.plans.base import Tables, query
from quarry.plans.evaluation import GATE, HAN, NORM, PRED, SCORE, SHARE, gates, scored
from quarry.plans.retrieval import expected_hits

_SAYS = f"contains({NORM.format('answer')}, {NORM.format('k')})"
_MARKS = "|".join(X.REFUSALS)
_TITLE = "left(" + NORM.format("k") + ", 8)"
CATEGORIES = ("refusal", "edge", "metadata", "fact", "summary", "compare", "multi_turn")
#: Verdicts on all cases. Answers, errors and expected values follow from the case's number, so that every branch has cases.
CASES = f"""{SCORE},
ei AS (SELECT case_id, list_sort(list(DISTINCT item)) AS items, list_sort(list(DISTINCT item || ' findings')) AS titles FROM ex GROUP BY case_id),
c0 AS (SELECT item_id AS case_id, text, [{', '.join(map(repr, CATEGORIES))}][(item_id % 7 + 1)::INTEGER] AS category, CASE WHEN item_id % 13 = 5 THEN 'timed out' END AS error, item_id % 9 <> 4 AS has_results,
  CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '没有找到相关的文献' WHEN 2 THEN text WHEN 3 THEN left(text, 40) ELSE 'See src' || (item_id % 20)::VARCHAR || ' findings.' END AS answer,
  CASE WHEN item_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(text, ' ')[1:6] END AS keywords, CASE WHEN item_id % 4 = 3 THEN {HAN.format('text')} ELSE text END AS question,
  CASE WHEN item_id % 8 = 1 THEN CAST([] AS VARCHAR[]) ELSE string_split(text, ' ')[1:2] END AS vals, 'run' || (item_id % 4)::VARCHAR AS run, (item_id * 37 % 1000)::DOUBLE AS latency_ms, CASE WHEN item_id % 3 > 0 THEN item_id % 11 > 1 END AS intent_ok FROM benchmark),
c1 AS (SELECT c0.*, chunk_hit, item_hit, coalesce(titles, CAST([] AS VARCHAR[])) AS titles, items IS NOT NULL AS has_expected, list_filter(keywords, lambda k: {NORM.format('k')} <> '') AS wanted FROM c0 JOIN res USING (case_id) LEFT JOIN ei ON ei.case_id = c0.case_id),
c2 AS (SELECT *, CASE WHEN has_results AND has_expected THEN chunk_hit OR item_hit END AS retrieval, CASE WHEN len(wanted) > 0 AND answer IS NOT NULL THEN len(list_filter(wanted, lambda k: {_SAYS})) / len(wanted) END AS keyword_rate,
  CASE WHEN len(wanted) > 0 AND answer IS NOT NULL THEN len(list_filter(wanted, lambda k: {_SAYS})) >= 0.5 * len(wanted) END AS key_ok,
  len(list_filter(titles, lambda k: length({_TITLE}) = 8 AND contains({NORM.format('answer')}, {_TITLE}))) > 0 AS cited, len(list_filter(vals, lambda k: {_SAYS})) = len(vals) AND len(vals) > 0 AS has_values,
  len(list_filter(keywords, lambda k: trim(k) <> '')) > 0 AND {SHARE.format('question')} AND 2 * len(list_filter(list_filter(keywords, lambda k: trim(k) <> ''), lambda x: regexp_matches(x, '[A-Za-z一-鿿]') AND NOT {SHARE.format('x')})) > len(list_filter(keywords, lambda k: trim(k) <> '')) AS crossed FROM c1),
c3 AS (SELECT *, CASE WHEN answer IS NULL THEN NULL WHEN crossed THEN cited OR coalesce(key_ok, false) ELSE key_ok END AS said FROM c2),
ve AS (SELECT *, error IS NULL AND category = 'refusal' AND answer IS NULL AS unjudged, CASE WHEN error IS NOT NULL THEN false WHEN category = 'refusal' THEN answer IS NULL OR regexp_matches(answer, '{_MARKS}')
  WHEN category = 'edge' THEN coalesce(trim(answer) <> '', false) OR (has_results AND NOT has_expected) WHEN category = 'metadata' THEN CASE WHEN answer IS NULL THEN coalesce(retrieval, true) ELSE has_values END
  WHEN retrieval IS NULL AND said IS NULL THEN false ELSE coalesce(retrieval, true) AND coalesce(said, true) END AS passed FROM c3)"""

def cases(t: Tables) -> DataFrame:
    """Every case with what was expected of it, what came and its answer."""
    n = F.col("item_id")
    words = lambda k: F.slice(F.split("text", " "), 1, k)
    none = F.array().cast("array<string>")
    answer = F.when(n % 5 == 0, None).when(n % 5 == 1, "没有找到相关的文献").when(n % 5 == 2, F.col("text")).when(n % 5 == 3, F.left("text", F.lit(40)))
    answer = answer.otherwise(F.concat(F.lit("See src"), (n % 20).cast("string"), F.lit(" findings.")))
    rows = t.benchmark.select(
        n.alias("case_id"), "text", F.element_at(F.array(*map(F.lit, CATEGORIES)), (n % 7 + 1).cast("int")).alias("category"), F.when(n % 13 == 5, "timed out").alias("error"), (n % 9 != 4).alias("has_results"), answer.alias("answer"),
        F.when(n % 6 == 0, none).otherwise(words(6)).alias("keywords"), F.when(n % 4 == 3, F.translate("text", "aeiours", "中文字人口大小")).otherwise(F.col("text")).alias("question"),
        F.when(n % 8 == 1, none).otherwise(words(2)).alias("vals"), F.concat(F.lit("run"), (n % 4).cast("string")).alias("run"), (n * 37 % 1000).cast("double").alias("latency_ms"), F.when(n % 3 > 0, n % 11 > 1).alias("intent_ok"),
    )
    sources = t.documents.select(F.col("doc_id").alias("key"), "source")
    expected = expected_hits(t).join(sources, "key").groupBy(F.col("query_id").alias("case_id")).agg(F.collect_set(F.concat("source", F.lit(" findings"))).alias("titles"))
    rows = rows.join(scored(t).select("case_id", "chunk_hit", "item_hit"), "case_id").join(expected, "case_id", "left")
    return rows.withColumn("has_expected", F.col("titles").isNotNull()).withColumn("titles", F.coalesce("titles", none))


def judged(rows: DataFrame) -> DataFrame:
    answer = F.col("answer")
    rows = rows.withColumn("retrieval", V.retrieval_verdict(F.col("has_results"), F.col("has_expected"), F.col("chunk_hit"), F.col("item_hit")))
    rows = rows.withColumn("kw", F.when(answer.isNotNull(), V.keyword_verdict(answer, F.col("keywords"))))
    verdict = V.case_verdict(
        category=F.col("category"), error=F.col("error"), answer=answer, has_results=F.col("has_results"), has_expected=F.col("has_expected"), retrieval=F.col("retrieval"), values=F.col("vals"),
        crossed=E.cross_lingual(F.col("question"), F.col("keywords")), cited=V.cites(answer, F.col("titles")), keywords=F.col("kw"),
    )
    return rows.withColumn("v", verdict).select("*", "v.passed", "v.unjudged", F.col("kw.rate").alias("keyword_rate")).drop("v", "kw")


@query("e7_case_verdict", f"WITH {CASES} SELECT case_id, category, passed, unjudged, retrieval, round(keyword_rate, 6) AS keyword_rate FROM ve")
def e7(t: Tables) -> DataFrame:
    """Errors, refusals, edge and metadata cases have rules of their own; all others need retrieval and keywords, or an expected title."""
    return judged(cases(t)).select("case_id", "category", "passed", "unjudged", "retrieval", F.round("keyword_rate", 6).alias("keyword_rate"))


@query(
    "e8_run_summary",
    f"""WITH {CASES} SELECT run, count(*)::BIGINT AS total, count(*) FILTER (NOT unjudged)::BIGINT AS judged, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FILTER (NOT unjudged), 6) AS pass_rate,
  round(avg(CASE WHEN intent_ok THEN 1.0 ELSE 0.0 END) FILTER (intent_ok IS NOT NULL), 6) AS intent_accuracy, round(avg(keyword_rate), 6) AS keyword_rate, round(avg(CASE WHEN chunk_hit THEN 1.0 ELSE 0.0 END) FILTER (has_expected), 6) AS chunk_hit_rate,
  round(avg(CASE WHEN item_hit THEN 1.0 ELSE 0.0 END) FILTER (has_expected), 6) AS item_hit_rate, round(median(latency_ms), 6) AS median_ms FROM ve GROUP BY run""",
)
def e8(t: Tables) -> DataFrame:
    return V.run_summary(judged(cases(t)), "run")


@query(
    "e11_failures",
    f"""WITH {CASES} SELECT 'error' AS kind, case_id, error AS detail FROM ve WHERE error IS NOT NULL UNION ALL SELECT 'hallucinated', case_id, left(answer, 80) FROM ve WHERE category = 'refusal' AND error IS NULL AND NOT passed AND NOT unjudged
UNION ALL SELECT 'failed', case_id, concat_ws('；', CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN NOT retrieval THEN 'not found' END, CASE WHEN keyword_rate < 0.5 THEN 'keywords ' || round_even(keyword_rate * 100, 0)::INTEGER::VARCHAR || ' %' END, CASE WHEN NOT intent_ok THEN 'intent' END) FROM ve WHERE NOT passed AND NOT unjudged""",
)
def e11_failures(t: Tables) -> DataFrame:
    """Errors, answers to questions that should have been refused, and failed cases with their reasons."""
    return V.failures(judged(cases(t)))


@query(
    "e12_rescore",
    f"""WITH {CASES}, st AS (SELECT case_id, left(text, 60) AS answer, passed AS before FROM ve WHERE case_id % 2 = 0 UNION ALL SELECT -case_id - 1, answer, passed FROM ve WHERE case_id % 7 = 0),
n1 AS (SELECT st.case_id, before, c1.* EXCLUDE (case_id, answer, error), st.answer, NULL::VARCHAR AS error FROM st JOIN c1 ON c1.case_id = st.case_id),
n2 AS (SELECT *, CASE WHEN has_results AND has_expected THEN chunk_hit OR item_hit END AS retrieval, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda k: {_SAYS})) >= 0.5 * len(wanted) END AS key_ok,
  len(list_filter(titles, lambda k: length({_TITLE}) = 8 AND contains({NORM.format('answer')}, {_TITLE}))) > 0 AS cited, len(list_filter(vals, lambda k: {_SAYS})) = len(vals) AND len(vals) > 0 AS has_values,
  len(list_filter(keywords, lambda k: trim(k) <> '')) > 0 AND {SHARE.format('question')} AND 2 * len(list_filter(list_filter(keywords, lambda k: trim(k) <> ''), lambda x: regexp_matches(x, '[A-Za-z一-鿿]') AND NOT {SHARE.format('x')})) > len(list_filter(keywords, lambda k: trim(k) <> '')) AS crossed FROM n1),
n3 AS (SELECT *, CASE WHEN crossed THEN cited OR coalesce(key_ok, false) ELSE key_ok END AS said FROM n2)
SELECT case_id, before, CASE WHEN category = 'refusal' THEN regexp_matches(answer, '{_MARKS}') WHEN category = 'edge' THEN trim(answer) <> '' OR (has_results AND NOT has_expected) WHEN category = 'metadata' THEN has_values
  WHEN retrieval IS NULL AND said IS NULL THEN false ELSE coalesce(retrieval, true) AND coalesce(said, true) END AS passed, NULL::BIGINT AS unmatched FROM n3
UNION ALL SELECT NULL, NULL, NULL, (SELECT count(*) FROM st WHERE case_id NOT IN (SELECT case_id FROM c0))""",
)
def e12(t: Tables) -> DataFrame:
    """Stored answers under the rules of their cases; answers without a case are counted and skipped (the row without an id)."""
    known = judged(cases(t))
    stored = known.where("case_id % 2 = 0").select("case_id", F.left("text", F.lit(60)).alias("answer"), F.col("passed").alias("before"))
    stored = stored.unionByName(known.where("case_id % 7 = 0").select((-F.col("case_id") - 1).alias("case_id"), "answer", F.col("passed").alias("before")))
    again = judged(cases(t).drop("answer", "error").withColumn("error", F.lit(None).cast("string")).join(stored, "case_id"))
    rows = again.select("case_id", "before", "passed", F.lit(None).cast("long").alias("unmatched"))
    lost = stored.join(t.benchmark.select(F.col("item_id").alias("case_id")), "case_id", "left_anti").agg(F.count("*").alias("unmatched"))
    return rows.unionByName(lost, allowMissingColumns=True)


SWEEP = f"""{GATE}, cu AS (SELECT i / 100.0::DOUBLE AS cut FROM range(0, 101) AS r(i)),
sw AS (SELECT cut, round(avg(CASE WHEN score >= cut THEN 1.0 ELSE 0.0 END) FILTER (answerable), 4) AS pass_rate, round(avg(CASE WHEN score < cut THEN 1.0 ELSE 0.0 END) FILTER (NOT answerable), 4) AS reject_rate FROM g, cu GROUP BY cut)"""
#: Quantiles of a distribution, by index.
SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query("e14_best_threshold", f"WITH {SWEEP} SELECT *, round(pass_rate + reject_rate - 1, 4) AS youden FROM sw ORDER BY youden DESC, cut LIMIT 1")
def e14_best(t: Tables) -> DataFrame:
    """The best of the 101 cuts, the smallest of equal ones."""
    return V.best_cut(E.sweep(gates(t), "score", "answerable"))


@query(
    "e14_distribution",
    f"WITH {GATE}, l AS (SELECT answerable, list_sort(list(score::DOUBLE)) AS v, count(*) AS n FROM g GROUP BY answerable) SELECT answerable, n::BIGINT AS n, v[1] AS least, "
    + ", ".join(f"v[(least(n - 1, floor(n * {q})) + 1)::BIGINT] AS {name}" for name, q in SHARES.items())
    + ", v[n] AS most FROM l",
)
def e14_distribution(t: Tables) -> DataFrame:
    return E.index_quantiles(gates(t), ["answerable"], "score", SHARES, least="least", most="most")


CUTS = (0.2, 0.35, 0.5, 0.65, 0.8)


@query(
    "e15_candidates",
    f"WITH {GATE}, la AS (SELECT g.*, lang FROM g JOIN documents USING (doc_id)) SELECT lang, count(*)::BIGINT AS n, cut::DOUBLE AS cut, round(avg(CASE WHEN score >= cut THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM la, unnest([{', '.join(f'{c}::DOUBLE' for c in CUTS)}]) AS u(cut) GROUP BY lang, cut",
)
def e15_candidates(t: Tables) -> DataFrame:
    """How much of each category would pass at each candidate of a gate."""
    return V.candidate_rates(gates(t).join(t.documents.select("doc_id", "lang"), "doc_id"), "lang", "score", CUTS)


@query("e15_refusal_mix", f"WITH {GATE} SELECT source AS intent, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g JOIN documents USING (doc_id) WHERE NOT answerable GROUP BY source")
def e15_mix(t: Tables) -> DataFrame:
    """Which intents (sources here) the questions that should be refused have."""
    mix = gates(t).where("not answerable").join(t.documents.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("intent")).agg(F.count("*").alias("n"))
    whole = mix.agg(F.sum("n").alias("all"))  # one row
    return mix.crossJoin(F.broadcast(whole)).select("intent", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


LATE = PRED.replace("FROM events", ", value * 10 AS latency_ms FROM events")


def predicted(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("event_type").alias("gold"), before.alias("pred"), (F.col("value") * 10).alias("latency_ms"))


@query(
    "e16_overall",
    f"""WITH {LATE}, a AS (SELECT gold AS class, count(*) AS support, count(*) FILTER (gold = pred) AS correct FROM p GROUP BY gold), b AS (SELECT pred AS class, count(*) AS predicted FROM p WHERE pred IS NOT NULL GROUP BY pred),
f AS (SELECT round(2 * correct / (support + predicted), 6) AS f1 FROM a JOIN b USING (class) WHERE correct > 0), l AS (SELECT list_sort(list(latency_ms)) AS v, count(*) AS n FROM p)
SELECT n::BIGINT AS n, (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, (SELECT round(avg(latency_ms), 6) FROM p) AS mean_ms, v[least(n - 1, n // 2) + 1] AS p50_ms FROM l""",
)
def e16_overall(t: Tables) -> DataFrame:
    return V.overall(predicted(t), "gold", "pred", "latency_ms")


@query("e16_confusions", f"WITH {PRED} SELECT gold, pred, count(*)::BIGINT AS n FROM p WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10")
def e16_confusions(t: Tables) -> DataFrame:
    return V.confusions(predicted(t), "gold", "pred", 10)
