"""Evaluation queries.

Cases are the passages of `benchmark`: a document that holds the passage is the expected hit, its source the expected item.
Runs, intents and verdicts come from `events`; gold labels from `labels`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import contain as C
from quarry.operators import evaluate as E
from quarry.plans.base import Tables, query
from quarry.plans.retrieval import BM25_CTE, bm25, expected_hits

NORM = r"regexp_replace(lower(coalesce({0}, '')), '[\s　，。；：、（）【】「」『』《》〈〉“”‘’！？·—－–…,.;:()\[\]{{}}<>\"''`!?/\\|~@#$%^&*+=_-]+', '', 'g')"


@query("e1_contains", f"SELECT b.item_id, d.doc_id FROM benchmark b, documents d WHERE {NORM.format('b.text')} <> '' AND contains({NORM.format('d.text')}, {NORM.format('b.text')})")
def e1(t: Tables) -> DataFrame:
    """The passages ask all documents, both normalised, by an automaton."""
    asked = t.benchmark.select("item_id", X.normalized(F.col("text")).alias("needle"))
    docs = t.documents.select("doc_id", X.normalized(F.col("text")).alias("hay"))
    return C.contained(docs, asked, key="doc_id", text="hay", passage_key="item_id", passage="needle")


@query(
    "e2_keyword_coverage",
    f"""WITH h AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
k AS (SELECT conv_id, turn, {NORM.format('text')} AS n, list_filter(string_split(coalesce(asked, ''), ' '), lambda k: {NORM.format('k')} <> '') AS w FROM h WHERE role = 'assistant')
SELECT conv_id, turn, len(list_filter(w, lambda k: contains(n, {NORM.format('k')})))::BIGINT AS hit, len(w)::BIGINT AS total, array_to_string(list_filter(w, lambda k: NOT contains(n, {NORM.format('k')})), ',') AS missing FROM k""",
)
def e2(t: Tables) -> DataFrame:
    """How many words of its question an answer says."""
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("words", F.split(F.coalesce(asked, F.lit("")), " ")).where("role = 'assistant'")
    c = rows.select("conv_id", "turn", E.keyword_coverage(F.col("text"), F.col("words")).alias("c"))
    return c.select("conv_id", "turn", F.col("c.hit").cast("long").alias("hit"), F.col("c.total").cast("long").alias("total"), F.array_join("c.missing", ",").alias("missing"))


SCORE = f"""{BM25_CTE},
ex AS (SELECT b.item_id AS case_id, d.doc_id AS key, d.source AS item, d.lang FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
rs AS (SELECT query_id AS case_id, bm.key, source AS item, rank FROM bm JOIN documents ON doc_id = bm.key WHERE rank <= 10),
ca AS (SELECT item_id AS case_id FROM benchmark),
ch AS (SELECT case_id, min(rank) AS hit_rank FROM rs JOIN ex USING (case_id, key) GROUP BY case_id),
it AS (SELECT DISTINCT case_id FROM rs JOIN ex USING (case_id, item)),
sco AS (SELECT ca.case_id, hit_rank IS NOT NULL AS chunk_hit, it.case_id IS NOT NULL AS item_hit, hit_rank FROM ca LEFT JOIN ch USING (case_id) LEFT JOIN it ON it.case_id = ca.case_id),
la AS (SELECT case_id, min(lang) AS category FROM ex GROUP BY case_id),
res AS (SELECT sco.*, coalesce(category, 'none') AS category FROM sco LEFT JOIN la USING (case_id))"""


def scored(t: Tables) -> DataFrame:
    """Every case with its retrieval score and, as its category, the language of the expected document (or none)."""
    sources = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("item"))
    expected = expected_hits(t).withColumnRenamed("query_id", "case_id").join(sources, "key")
    results = bm25(t, 10).select(F.col("query_id").alias("case_id"), "key", F.col("rank").cast("long").alias("rank")).join(sources, "key")
    cases = t.benchmark.select(F.col("item_id").alias("case_id"))
    category = expected.groupBy("case_id").agg(F.min("lang").alias("category"))
    score = E.retrieval_score(cases, expected.select("case_id", "key", "item"), results)
    return score.join(category, "case_id", "left").withColumn("category", F.coalesce("category", F.lit("none")))


@query("e3_retrieval_score", f"WITH {SCORE} SELECT case_id, chunk_hit, item_hit, hit_rank FROM res")
def e3(t: Tables) -> DataFrame:
    return scored(t).select("case_id", "chunk_hit", "item_hit", "hit_rank")


@query("e4_refusals", f"SELECT conv_id, turn, regexp_matches(text, '{'|'.join(X.REFUSALS)}|nothing|nicht|aucun') AS refuses FROM conversations")
def e4(t: Tables) -> DataFrame:
    """The fixed markers, and a table of markers for other languages."""
    return t.conversations.select("conv_id", "turn", (X.refuses(F.col("text")) | F.col("text").rlike("nothing|nicht|aucun")).alias("refuses"))


HAN = "translate({0}, 'aeiours', '中文字人口大小')"
SHARE = "(CASE WHEN length({0}) > 0 THEN (length({0}) - length(regexp_replace({0}, '[一-鿿]', '', 'g'))) / length({0}) ELSE 0 END > 0.3)"


@query(
    "e5_cross_lingual",
    f"""WITH c AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text ELSE {HAN.format('text')} END AS q, list_filter(string_split(text, ' ')[1:6], lambda k: trim(k) <> '') AS k0 FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, q, CASE WHEN doc_id % 3 = 0 THEN list_transform(k0, lambda k: {HAN.format('k')}) ELSE k0 END AS k FROM c)
SELECT doc_id, len(k) > 0 AND {SHARE.format('q')} AND 2 * len(list_filter(k, lambda x: regexp_matches(x, '[A-Za-z一-鿿]') AND NOT {SHARE.format('x')})) > len(k) AS crossed FROM k""",
)
def e5(t: Tables) -> DataFrame:
    """Texts as questions, most of them with letters turned into another script, and their first words as keywords."""
    han = lambda c: F.translate(c, "aeiours", "中文字人口大小")
    question = F.when(F.col("lang") == "fr", F.col("text")).otherwise(han(F.col("text")))
    words = F.slice(F.split("text", " "), 1, 6)
    keywords = F.when(F.col("doc_id") % 3 == 0, F.transform(words, han)).otherwise(words)
    return t.documents.where("text is not null").select("doc_id", E.cross_lingual(question, keywords).alias("crossed"))


@query(
    "e6_title_citation",
    f"""WITH ti AS (SELECT doc_id, left({NORM.format("string_split(text, chr(10))[1]")}, 8) AS p FROM documents),
tt AS (SELECT p, min(doc_id) AS cited FROM ti WHERE length(p) = 8 GROUP BY p),
an AS (SELECT conv_id, turn, {NORM.format('text')} AS n FROM conversations WHERE role = 'assistant'),
gr AS (SELECT conv_id, turn, i, substr(n, i, 8) AS p FROM an, unnest(range(1, greatest(length(n) - 6, 1))) AS r(i) WHERE length(n) >= 8)
SELECT conv_id, turn, min_by(cited, (i, cited)) AS cited FROM gr JOIN tt USING (p) GROUP BY ALL""",
)
def e6(t: Tables) -> DataFrame:
    """The first title whose 8-letter prefix an answer holds: the answers' 8-grams join the prefixes.

    Spark takes the grams for as small as the answers' file and would broadcast them; so the prefixes are hashed, part by part.
    """
    prefix = F.left(X.normalized(X.first_line(F.col("text"))), F.lit(8))
    titles = t.documents.select("doc_id", prefix.alias("p")).where("length(p) = 8").groupBy("p").agg(F.min("doc_id").alias("cited"))
    said = t.conversations.where("role = 'assistant'").select("conv_id", "turn", X.normalized(F.col("text")).alias("n")).where("length(n) >= 8")
    grams = said.select("conv_id", "turn", "n", F.explode(F.sequence(F.lit(1), F.length("n") - 7)).alias("i")).select("conv_id", "turn", "i", F.expr("substring(n, i, 8)").alias("p"))
    return grams.join(titles.hint("shuffle_hash"), "p").groupBy("conv_id", "turn").agg(F.min_by("cited", F.struct("i", "cited")).alias("cited"))


RUN = """run AS (SELECT event_id, ts, event_type AS category, user_id, strftime(ts, '%Y-%m-%d') AS run, value > 40 AS passed, value < 2 AS unjudged, value * 10 AS latency_ms,
  CASE WHEN event_type = 'error' THEN NULL ELSE (user_id % 3 > 0) END AS intent_ok, CASE WHEN value < 90 THEN floor(value / 10) + 1 END AS hit_rank FROM events)"""


def runs(t: Tables) -> DataFrame:
    """Results of evaluation runs, one run a day."""
    v = F.col("value")
    return t.events.select(
        "event_id", "ts", F.col("event_type").alias("category"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("run"), (v > 40).alias("passed"), (v < 2).alias("unjudged"), (v * 10).alias("latency_ms"),
        F.when(F.col("event_type") != "error", F.col("user_id") % 3 > 0).alias("intent_ok"), F.when(v < 90, F.floor(v / 10) + 1).alias("hit_rank"),
    )


def share(condition):
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


@query(
    "e9_category_report",
    f"WITH {SCORE} SELECT coalesce(category, 'all') AS category, count(*)::BIGINT AS n, round(avg(CASE WHEN item_hit THEN 1.0 ELSE 0.0 END), 6) AS recall, round(sum(coalesce(1.0::DOUBLE / hit_rank, 0)) / count(*), 6) AS mrr FROM res GROUP BY ROLLUP (category)",
)
def e9(t: Tables) -> DataFrame:
    mrr = F.round(F.sum(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))) / F.count("*"), 6)
    return scored(t).rollup("category").agg(F.count("*").alias("n"), share(F.col("item_hit")).alias("recall"), mrr.alias("mrr")).withColumn("category", F.coalesce("category", F.lit("all")))


@query(
    "e10_category_end_to_end",
    f"""WITH {RUN} SELECT coalesce(category, 'all') AS category, count(*)::BIGINT AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate_all,
  round(avg(CASE WHEN unjudged THEN NULL WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate_judged FROM run GROUP BY ROLLUP (category)""",
)
def e10(t: Tables) -> DataFrame:
    """Two pass rates: over all rows, and over the judged ones."""
    judged = F.when(~F.col("unjudged"), F.when(F.col("passed"), 1.0).otherwise(0.0))
    out = runs(t).rollup("category").agg(F.count("*").alias("n"), share(F.col("passed")).alias("pass_rate_all"), F.round(F.avg(judged), 6).alias("pass_rate_judged"))
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


@query(
    "e11_failure_reasons",
    f"WITH {RUN} SELECT event_id, concat_ws('；', CASE WHEN category = 'error' THEN 'error' END, CASE WHEN hit_rank IS NULL THEN 'not found' END, CASE WHEN NOT intent_ok THEN 'intent' END) AS reasons FROM run WHERE NOT passed",
)
def e11(t: Tables) -> DataFrame:
    reasons = F.concat_ws("；", F.when(F.col("category") == "error", "error"), F.when(F.col("hit_rank").isNull(), "not found"), F.when(~F.col("intent_ok"), "intent"))
    return runs(t).where("not passed").select("event_id", reasons.alias("reasons"))


@query(
    "e13_trend",
    f"""WITH {RUN}, r AS (SELECT run, round(avg(CASE WHEN unjudged THEN NULL WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM run GROUP BY run)
SELECT run, pass_rate, round(pass_rate - lag(pass_rate) OVER (ORDER BY run), 6) AS delta FROM r""",
)
def e13(t: Tables) -> DataFrame:
    judged = F.when(~F.col("unjudged"), F.when(F.col("passed"), 1.0).otherwise(0.0))
    rates = runs(t).groupBy("run").agg(F.round(F.avg(judged), 6).alias("pass_rate"))  # one row a run
    return rates.withColumn("delta", F.round(F.col("pass_rate") - F.lag("pass_rate").over(Window.orderBy("run")), 6))


GATE = "g AS (SELECT doc_id, ((doc_id * 7919) % 1000) / 1000.0 AS score, quality = 1 AS answerable FROM labels)"


def gates(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", "quality", ((F.col("doc_id") * 7919) % 1000 / 1000).alias("score"), (F.col("quality") == 1).alias("answerable"))


@query(
    "e14_threshold_sweep",
    f"""WITH {GATE}, c AS (SELECT i / 100.0::DOUBLE AS cut FROM range(0, 101) AS r(i)),
s AS (SELECT cut, round(avg(CASE WHEN score >= cut THEN 1.0 ELSE 0.0 END) FILTER (answerable), 4) AS pass_rate, round(avg(CASE WHEN score < cut THEN 1.0 ELSE 0.0 END) FILTER (NOT answerable), 4) AS reject_rate FROM g, c GROUP BY cut)
SELECT *, round(pass_rate + reject_rate - 1, 4) AS youden FROM s""",
)
def e14(t: Tables) -> DataFrame:
    return E.sweep(gates(t), "score", "answerable")


@query(
    "e15_gate_calibration",
    f"WITH {GATE}, l AS (SELECT answerable, list_sort(list(score::DOUBLE)) AS v, count(*) AS n FROM g GROUP BY answerable) SELECT answerable, n::BIGINT AS n, v[1] AS least, v[(least(n - 1, floor(n * 0.1)) + 1)::BIGINT] AS p10, v[(least(n - 1, floor(n * 0.5)) + 1)::BIGINT] AS p50, v[n] AS most FROM l",
)
def e15(t: Tables) -> DataFrame:
    return E.index_quantiles(gates(t), ["answerable"], "score", {"p10": 0.1, "p50": 0.5}, least="least", most="most")


PRED = "p AS (SELECT event_type AS gold, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events)"


def predictions(t: Tables) -> DataFrame:
    """The type of an event, predicted to be that of the user's event before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("event_type").alias("gold"), before.alias("pred"))


@query(
    "e16_class_report",
    f"""WITH {PRED}, a AS (SELECT gold AS class, count(*) AS support, count(*) FILTER (gold = pred) AS correct FROM p GROUP BY gold), b AS (SELECT pred AS class, count(*) AS predicted FROM p WHERE pred IS NOT NULL GROUP BY pred)
SELECT class, support::BIGINT AS support, coalesce(predicted, 0)::BIGINT AS predicted, correct::BIGINT AS correct, round(correct / predicted, 6) AS precision, round(correct / support, 6) AS recall, round(2 * correct / (support + predicted), 6) AS f1 FROM a LEFT JOIN b USING (class)""",
)
def e16(t: Tables) -> DataFrame:
    return E.class_report(predictions(t), "gold", "pred")


@query(
    "e17_parse_label",
    "SELECT event_id, CASE WHEN value < 50 THEN event_type WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unparsed' END AS label FROM events",
)
def e17(t: Tables) -> DataFrame:
    """Model output: a thought to be dropped, then JSON or a sentence; labels outside the list do not parse."""
    thought = F.lit("<think>purchase?\n</think>")
    said = F.when(F.col("value") < 50, F.concat(thought, F.lit('{"intent": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.concat(thought, F.lit("It is a "), F.col("event_type")))
    clean = F.regexp_replace("said", "(?s)<think>.*?</think>", "")
    by_key = F.nullif(F.get_json_object("clean", "$.intent"), F.lit(""))
    by_word = F.nullif(F.regexp_extract("clean", "\\b(view|click)\\b", 1), F.lit(""))
    rows = t.events.select("event_id", said.alias("said")).withColumn("clean", clean)
    return rows.select("event_id", F.coalesce(F.when(F.startswith(F.col("clean"), F.lit("{")), by_key), by_word, F.lit("unparsed")).alias("label"))


@query("e18_judge_rollup", "SELECT coalesce(lang, 'all') AS category, count(*)::BIGINT AS n, sum(quality)::BIGINT AS ok, sum(toxic)::BIGINT AS fabricated, round(avg(quality), 6) AS ok_rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def e18(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    out = rows.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("ok"), F.sum("toxic").alias("fabricated"), F.round(F.avg("quality"), 6).alias("ok_rate"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("category"), "n", "ok", "fabricated", "ok_rate")


TOOLS = "t AS (SELECT user_id, list_sort(list(event_type)) AS called, list_sort(list(DISTINCT event_type)) AS kinds FROM events WHERE value > 60 GROUP BY user_id)"


def tools(t: Tables) -> DataFrame:
    """Per user: the number of calls and the set of types called (of which there are a handful)."""
    return t.events.where("value > 60").groupBy("user_id").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query(
    "e19_tool_path",
    """WITH c AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN [] ELSE list_sort(list(event_type)) END AS called FROM events WHERE value > 90 GROUP BY user_id),
x AS (SELECT user_id, called, CASE user_id % 4 WHEN 0 THEN 'compare' WHEN 1 THEN 'metadata' ELSE 'qa' END AS intent, user_id % 2 = 0 AS history,
  CASE WHEN user_id % 3 = 0 THEN ['view', 'view', 'click'] WHEN user_id % 5 = 0 THEN [] ELSE ['click', 'view'] END AS wanted, CASE WHEN user_id % 8 = 2 THEN [['view', 'click'], ['purchase', 'signup']] END AS groups FROM c)
SELECT user_id, CASE WHEN intent = 'compare' THEN called = list_sort(wanted) WHEN len(called) = 0 AND history THEN true
  WHEN groups IS NOT NULL THEN list_has_any(called, groups[1]) AND list_has_any(called, groups[2]) WHEN intent = 'metadata' THEN list_has_any(called, ['signup', 'error'])
  ELSE list_has_all(called, wanted) END AS tools_ok FROM x""",
)
def e19(t: Tables) -> DataFrame:
    """Calls of each user, counted by kind, against what its case wants."""
    lit = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    u = F.col("user_id")
    per_kind = t.events.where("value > 90").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    called = per_kind.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("called"))
    called = called.withColumn("called", F.when(u % 7 == 0, F.slice("called", 1, 0)).otherwise(F.col("called")))
    wanted = F.when(u % 3 == 0, lit("view", "view", "click")).when(u % 5 == 0, lit()).otherwise(lit("click", "view"))
    groups = F.when(u % 8 == 2, F.array(lit("view", "click"), lit("purchase", "signup")))
    intent = F.when(u % 4 == 0, "compare").when(u % 4 == 1, "metadata").otherwise("qa")
    ok = E.tool_path(F.col("called"), wanted, groups, intent, u % 2 == 0, compare="compare", metadata="metadata", metadata_tools=["signup", "error"])
    return called.select("user_id", ok.alias("tools_ok"))


@query("e20_set_recall", f"WITH {TOOLS} SELECT user_id, round(len(list_intersect(kinds, ['click', 'view', 'error'])) / 3.0, 6) AS recall FROM t")
def e20(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("click", "view", "error")))
    return tools(t).select("user_id", F.round(F.size(F.array_intersect("kinds", wanted)) / F.lit(3.0), 6).alias("recall"))


@query(
    "e21_figure_questions",
    f"""WITH c AS (SELECT page_id, CASE WHEN page_id % 10 = 0 AND page_id % 20 = 0 THEN '没有找到相关的文献' WHEN page_id % 10 = 0 THEN 'It is 42.' ELSE html END AS a, page_id % 10 = 0 AS trap, ['the', 'nicht', '', 'que'] AS k,
  CASE WHEN page_id % 3 > 0 THEN 'figures/p' || page_id % 7 || '.png' ELSE '' END AS image, ['x/p1.png', 'http://h/p' || page_id % 5 || '.png?s=1'] AS images FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN trap THEN regexp_matches(a, '{"|".join(X.REFUSALS)}') ELSE 2 * len(list_filter(k, lambda x: x <> '' AND contains(a, x))) >= len(k) END AS passed,
  CASE WHEN NOT trap AND image <> '' THEN contains(images[1], string_split(image, '/')[-1]) OR contains(images[2], string_split(image, '/')[-1]) END AS figure_hit FROM c""",
)
def e21(t: Tables) -> DataFrame:
    """Questions on figures: keywords as they stand, the image among the sources, traps that have to be refused."""
    p = F.col("page_id")
    answer = F.when(p % 20 == 0, "没有找到相关的文献").when(p % 10 == 0, "It is 42.").otherwise(F.col("html"))
    image = F.when(p % 3 > 0, F.concat(F.lit("figures/p"), (p % 7).cast("string"), F.lit(".png"))).otherwise("")
    images = F.array(F.lit("x/p1.png"), F.concat(F.lit("http://h/p"), (p % 5).cast("string"), F.lit(".png?s=1")))
    words = F.array(*map(F.lit, ("the", "nicht", "", "que")))
    rows = t.pages.where("html is not null").select("page_id", E.figure_score(answer, words, image, images, p % 10 == 0).alias("s"))
    return rows.select("page_id", "s.passed", "s.figure_hit")


INTENTS, TOOLS_OF, TRAPS = ["qa", "metadata", "compare", "report"], ["cards", "papers", "slides", "by_item"], ["clean", "paraphrase", "exact", "scope"]
#: A generated data set of cases, most of them with something wrong, as columns that both engines can work out.
CASES = {
    "intent": "CASE WHEN n % 31 = 0 THEN 'odd' ELSE {pick_intent} END",
    "intent_not": "CASE WHEN n % 29 = 0 THEN 'odd' WHEN n % 23 = 0 THEN {pick_intent} WHEN {pick_intent} = 'qa' THEN 'report' ELSE 'qa' END",
    "task_type": "CASE WHEN n % 37 = 0 THEN 'odd' WHEN {pick_intent} = 'report' THEN 'group_report' ELSE 'simple' END",
    "tools": "CASE WHEN n % 19 = 0 THEN {array}('magic') WHEN n % 13 = 0 THEN {none} WHEN {pick_intent} = 'report' THEN {array}('cards', 'papers', 'slides') WHEN {pick_intent} = 'compare' THEN {array}('by_item', 'by_item') WHEN {pick_intent} = 'metadata' THEN {array}('cards') ELSE {none} END",
    "groups": "CASE WHEN n % 41 = 0 THEN {array}('magic') WHEN n % 17 = 0 THEN {array}('cards') ELSE {none} END",
    "item_ids": "CASE WHEN n % 11 = 0 THEN {array}('7') WHEN {pick_intent} = 'compare' AND n % 5 > 0 THEN {array}('001', '002') ELSE {none} END",
    "question": "CASE WHEN n % 3 = 0 THEN 'What does 017 say?' WHEN n % 7 = 0 THEN 'What does #4 say?' ELSE 'What is said on it?' END",
    "nodes": "CASE WHEN n % 43 = 0 THEN {array}('nowhere') WHEN n % 2 = 0 THEN {array}('retrieval') ELSE {array}('intent', 'e2e') END",
    "refusal": "n % 9 = 0",
    "relevant": "CASE WHEN n % 4 = 0 THEN {array}('001') ELSE {none} END",
    "keywords": "CASE WHEN n % 5 = 0 THEN {none} ELSE {array}('word') END",
    "history": "CASE WHEN n % 6 = 0 THEN {array}('User: before') WHEN n % 47 = 0 THEN {array}('before') ELSE {none} END",
    "has_rewrite": "n % 6 = 0 AND n % 12 > 0",
    "trap": "CASE WHEN n % 53 = 0 THEN 'odd' WHEN n % 4 = 0 THEN 'clean' WHEN n % 4 = 1 THEN 'paraphrase' ELSE 'scope' END",
    "checkpoints": "n % 6",
    "difficulty": "CASE WHEN n % 10 < 5 THEN 'easy' WHEN n % 10 < 8 THEN 'medium' ELSE 'hard' END",
}
IN = lambda column, names: f"({column} IN ({', '.join(map(repr, names))}))"
RULES = {
    "intent": f"NOT {IN('intent', INTENTS)}",
    "intent_not": f"NOT {IN('intent_not', INTENTS)}",
    "same_intent": "intent_not = intent",
    "task_type": f"NOT {IN('task_type', ['simple', 'group_report'])}",
    "tools": "NOT {within}(tools, {TOOLS})",
    "tool_groups": "NOT {within}(groups, {TOOLS})",
    "no_tools": "{len}(tools) = 0 AND {len}(groups) = 0 AND intent <> 'qa'",
    "metadata_tools": "intent = 'metadata' AND NOT {any}(tools, {array}('cards', 'papers'))",
    "compare_tools": "intent = 'compare' AND NOT {within}(tools, {array}('by_item'))",
    "compare_items": "intent = 'compare' AND ({len}(item_ids) < 2 OR {len}(item_ids) <> {len}(tools))",
    "report_tools": "task_type = 'group_report' AND NOT {within}({array}('cards', 'papers', 'slides'), tools)",
    "item_form": "{exists_odd}",
    "named_item": "{names_item} AND {len}(item_ids) = 0",
    "nodes": "NOT {within}(nodes, {array}('intent', 'retrieval', 'e2e'))",
    "retrieval_empty": "{any}(nodes, {array}('retrieval')) AND NOT refusal AND ({len}(relevant) = 0 OR {len}(keywords) = 0)",
    "refusal_relevant": "refusal AND {len}(relevant) > 0",
    "history_rewrite": "({len}(history) > 0) <> has_rewrite",
    "history_form": "{exists_bare}",
    "trap": f"NOT {IN('trap', TRAPS)}",
    "checkpoints": "NOT checkpoints BETWEEN 2 AND 4",
}
COUNT = "sum(CASE WHEN {0} THEN 1 ELSE 0 END)"
WHOLE = {
    "repeated_ids": "count(case_id) <> count(DISTINCT case_id)",
    **{f"missing_trap_{x}": f"{COUNT.format(f'trap = {x!r}')} < 1" for x in TRAPS},
    **{f"few_{x}": f"{COUNT.format(f'intent = {x!r}')} < 2" for x in INTENTS},
    "too_many_qa": f"{COUNT.format('intent = ' + repr('qa'))} > 0.4 * count(*)",
    "few_paraphrases": f"{COUNT.format(IN('trap', ['paraphrase', 'exact']))} < 4",
    "clean_share": f"NOT {COUNT.format('trap = ' + repr('clean'))} BETWEEN 0.1 * count(*) AND 0.2 * count(*)",
    "trap_share": f"{COUNT.format('trap <> ' + repr('clean'))} < 0.6 * count(*)",
    "history_share": f"NOT {COUNT.format('has_rewrite')} BETWEEN 0.15 * count(*) AND 0.25 * count(*)",
    **{f"share_{x}": f"abs({COUNT.format(f'difficulty = {x!r}')} - {n} * count(*) / 100.0) > 0.03 * count(*)" for x, n in (("easy", 30), ("medium", 45), ("hard", 25))},
}
_PICK = "CASE n % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'metadata' WHEN 2 THEN 'compare' ELSE 'report' END"
_DUCK = {
    "pick_intent": _PICK, "array": "list_value", "none": "CAST([] AS VARCHAR[])", "len": "len", "any": "list_has_any", "within": "within", "TOOLS": f"list_value({', '.join(map(repr, TOOLS_OF))})",
    "exists_odd": "len(list_filter(item_ids, lambda x: NOT regexp_full_match(x, '[0-9]{3}'))) > 0", "exists_bare": "len(list_filter(history, lambda x: NOT starts_with(x, 'User: '))) > 0",
    "names_item": "regexp_matches(question, '#[0-9]+|\\b[0-9]{3}\\b')",
}
_SPARK = {
    **_DUCK, "array": "array", "none": "cast(array() as array<string>)", "len": "size", "any": "arrays_overlap", "TOOLS": f"array({', '.join(map(repr, TOOLS_OF))})",
    "exists_odd": "exists(item_ids, x -> not x rlike '^[0-9]{3}$')", "exists_bare": "exists(history, x -> not startswith(x, 'User: '))", "names_item": "question rlike '#[0-9]+|\\\\b[0-9]{3}\\\\b'",
}


def _said(text: str, words: dict[str, str]) -> str:
    """A rule in the words of an engine: within(a, b), all of a are in b, is spelt out."""
    import re

    for name, value in words.items():
        text = text.replace("{" + name + "}", value)
    within = "list_has_all({1}, {0})" if words is _DUCK else "(size(array_except({0}, {1})) = 0)"
    return re.sub(r"within\((\w+(?:\([^()]*\))?), (\w+(?:\([^()]*\))?)\)", lambda m: within.format(m[1], m[2]), text)


@query(
    "e22_lint",
    "WITH d AS (SELECT doc_id AS n FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 97 = 0), c AS (SELECT n::VARCHAR AS case_id, "
    + ", ".join(f"{_said(v, _DUCK)} AS {k}" for k, v in CASES.items())
    + " FROM d) "
    + " UNION ALL ".join(f"SELECT case_id, '{name}' AS rule FROM c WHERE {_said(rule, _DUCK)}" for name, rule in RULES.items())
    + "".join(f" UNION ALL SELECT NULL, '{name}' FROM c HAVING {rule}" for name, rule in WHOLE.items()),
)
def e22(t: Tables) -> DataFrame:
    """A set of cases against twenty rules of a row and the rules of its distribution: one row for each broken one."""
    ids = t.documents.select(F.col("doc_id").alias("n"))
    cases = ids.unionByName(ids.where("n % 97 = 0"))
    cases = cases.select(F.col("n").cast("string").alias("case_id"), *[F.expr(_said(v, _SPARK)).alias(k) for k, v in CASES.items()])
    return E.lint(cases, "case_id", {name: F.expr(_said(rule, _SPARK)) for name, rule in RULES.items()}, {name: F.expr(rule) for name, rule in WHOLE.items()})


@query(
    "e23_load_report",
    """WITH l AS (SELECT event_type AS level, count(*) AS n, count(*) FILTER (value < 5) AS errors, list_sort(list(value)) AS v, round(avg(value), 6) AS mean, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY event_type)
SELECT level, n::BIGINT AS n, errors::BIGINT AS errors, v[(least(n - 1, floor(n * 0.5)) + 1)::BIGINT] AS p50, v[(least(n - 1, floor(n * 0.9)) + 1)::BIGINT] AS p90, mean, round(n / (us / 1000000.0), 6) AS per_second FROM l""",
)
def e23(t: Tables) -> DataFrame:
    e = t.events.withColumnRenamed("event_type", "level")
    q = E.index_quantiles(e, ["level"], "value", {"p50": 0.5, "p90": 0.9}).drop("n")
    us = F.expr("max(unix_micros(cast(ts as timestamp))) - min(unix_micros(cast(ts as timestamp)))")
    base = e.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("errors"), F.round(F.avg("value"), 6).alias("mean"), us.alias("us"))
    return base.join(q, "level").select("level", "n", "errors", "p50", "p90", "mean", F.round(F.col("n") / (F.col("us") / F.lit(1000000.0)), 6).alias("per_second"))


@query("e24_case_selection", "WITH c AS (SELECT conv_id, min(role) FILTER (turn = 0) AS opening, count(*) FILTER (role = 'user') > 1 AS skipped FROM conversations GROUP BY conv_id) SELECT conv_id, skipped FROM c WHERE opening = 'user' ORDER BY conv_id LIMIT 50")
def e24(t: Tables) -> DataFrame:
    """The first 50 cases of the wanted kind: the number is the caller's. Cases of several turns are marked as skipped."""
    cases = t.conversations.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("opening"), (F.count_if(F.col("role") == "user") > 1).alias("skipped"))
    return cases.where("opening = 'user'").orderBy("conv_id").limit(50).select("conv_id", "skipped")


@query(
    "e25_intent_correctness",
    """SELECT event_id, CASE WHEN value >= 5 AND event_type NOT IN ('error', 'signup') THEN (CASE WHEN user_id % 4 > 0 THEN 'metadata_query' ELSE 'simple_qa' END) = CASE event_type WHEN 'view' THEN 'metadata_query' WHEN 'click' THEN 'simple_qa' ELSE 'summary_paper' END END AS intent_ok,
  CASE WHEN event_type = 'signup' AND event_id % 5 > 0 THEN event_id % 3 < 2 END AS item_ok FROM events""",
)
def e25(t: Tables) -> DataFrame:
    """Events as cases: their types stand for categories; small values have no intent, and every fifth case resolved no item."""
    kinds = {"view": "metadata", "click": "en_fact", "purchase": "summary_paper", "signup": "coreference", "error": "refusal"}
    category = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    intent = F.when(F.col("value") >= 5, F.when(F.col("user_id") % 4 > 0, "metadata_query").otherwise("simple_qa")).otherwise("")
    resolved = F.when(F.col("event_id") % 5 > 0, F.col("user_id") + F.col("event_id") % 3)
    checks = E.case_correctness(category, intent, resolved, F.array(F.col("user_id"), F.col("user_id") + 1))
    return t.events.select("event_id", *[c.alias(name) for name, c in zip(("intent_ok", "item_ok"), checks)])


@query("e26_case_question", "SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY conv_id")
def e26(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
