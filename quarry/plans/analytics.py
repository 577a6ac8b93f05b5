"""Log queries: `events` are requests (a thread is a user's day), `conversations` are threads of turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import logs as A
from quarry.plans.base import Tables, anchored_sql, query

LOG = """log AS (SELECT event_id, ts, user_id, event_type AS intent, event_type <> 'error' AS success, value * 10 AS latency_ms, floor(value * 100)::BIGINT AS tokens,
  (user_id % 30)::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS thread, props FROM events)"""


def log(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("intent"), (F.col("event_type") != "error").alias("success"), (F.col("value") * 10).alias("latency_ms"),
        F.floor(F.col("value") * 100).alias("tokens"), F.concat((F.col("user_id") % 30).cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("thread"), "props",
    )


@query("a1_last_turns", "WITH b AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM b")
def a1(t: Tables) -> DataFrame:
    return A.last_turns(t.conversations, "conv_id", "turn", 5).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


@query("a2_recent_logs", f"WITH {LOG} SELECT event_id, coalesce(json_extract_string(props, '$.page'), props) AS trace FROM log ORDER BY ts DESC, event_id DESC LIMIT 100")
def a2(t: Tables) -> DataFrame:
    """The newest 100 requests: the page size is the feature."""
    newest = log(t).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), "props").alias("trace"))


OWN = LOG + ", o AS (SELECT thread, min_by(user_id, (ts, event_id)) AS owner, max(ts) AS last_active FROM log GROUP BY thread)"


@query("a3_thread_owners", f"WITH {OWN} SELECT thread, owner, epoch_us(last_active) AS last_us, count(*) FILTER (user_id <> owner AND user_id <> 0)::BIGINT AS violations FROM log JOIN o USING (thread) GROUP BY ALL")
def a3(t: Tables) -> DataFrame:
    joined = log(t).join(A.owners(log(t), "thread", "user_id", "ts", "event_id"), "thread")
    others = (F.col("user_id") != F.col("owner")) & (F.col("user_id") != 0)
    return joined.groupBy("thread", "owner", F.expr("unix_micros(cast(last_active as timestamp))").alias("last_us")).agg(F.count_if(others).alias("violations"))


@query("a4_user_stats", f"WITH {OWN} SELECT user_id, count(DISTINCT thread)::BIGINT AS sessions, count(*)::BIGINT AS questions FROM log GROUP BY user_id")
def a4(t: Tables) -> DataFrame:
    return log(t).groupBy("user_id").agg(F.countDistinct("thread").alias("sessions"), F.count("*").alias("questions"))


@query("a5_token_use", f"WITH {LOG}, m AS (SELECT max(ts)::DATE AS today FROM log) SELECT user_id, coalesce(sum(tokens), 0)::BIGINT AS total, coalesce(sum(tokens) FILTER (ts::DATE = today), 0)::BIGINT AS today, count(*)::BIGINT AS requests FROM log, m GROUP BY user_id")
def a5(t: Tables) -> DataFrame:
    day = log(t).agg(F.to_date(F.max("ts")).alias("day"))  # one row
    dated = log(t).crossJoin(F.broadcast(day))
    today = F.sum(F.when(F.to_date("ts") == F.col("day"), F.col("tokens")))
    return dated.groupBy("user_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(today, F.lit(0)).alias("today"), F.count("*").alias("requests"))


@query(
    "a6_favourites",
    """SELECT 'favourite' AS part, user_id, page, NULL::INTEGER AS score, NULL::BIGINT AS n_chars FROM (SELECT user_id, json_extract_string(props, '$.page') AS page, max_by(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL) WHERE last = 'purchase'
UNION ALL SELECT 'feedback', user_id, json_extract_string(props, '$.page'), (event_id % 4 - 1)::INTEGER, least(500, 100 * length(event_type))::BIGINT FROM events WHERE event_id % 4 IN (0, 2)""",
)
def a6(t: Tables) -> DataFrame:
    """Favourites by their last event, and marks of questions: other scores than 1 and -1 do not count, long questions are cut."""
    page = F.get_json_object("props", "$.page")
    e = t.events.where("event_type in ('purchase', 'error')").withColumn("page", page)
    liked = A.favourites(e, ["user_id", "page"], F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    asked = t.events.select("user_id", page.alias("page"), F.repeat("event_type", F.lit(100)).alias("question"), (F.col("event_id") % 4 - 1).cast("int").alias("score"))
    marks = A.feedback(asked, "score", "question").select(F.lit("feedback").alias("part"), "user_id", "page", "score", F.length("question").cast("long").alias("n_chars"))
    return marks.unionByName(liked.withColumn("part", F.lit("favourite")), allowMissingColumns=True)


@query("a7_retention", f"WITH {LOG}, m AS (SELECT max(ts) - INTERVAL 7 DAY AS cut FROM log) SELECT CASE WHEN ts < cut THEN strftime(ts, '%Y-%m') ELSE 'kept' END AS part, count(*)::BIGINT AS n FROM log, m GROUP BY ALL")
def a7(t: Tables) -> DataFrame:
    cut = log(t).agg((F.max("ts") - F.expr("interval 7 days")).alias("cut"))  # one row
    part = F.when(F.col("ts") < F.col("cut"), F.date_format("ts", "yyyy-MM")).otherwise("kept")
    return log(t).crossJoin(F.broadcast(cut)).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("a8_stale_threads", f"WITH {LOG}, m AS (SELECT max(ts) - INTERVAL 3 DAY AS cut FROM log), s AS (SELECT thread FROM log, m GROUP BY thread, cut HAVING max(ts) < cut) SELECT thread, count(*)::BIGINT AS rows FROM log WHERE thread IN (SELECT thread FROM s) GROUP BY thread")
def a8(t: Tables) -> DataFrame:
    cut = log(t).agg((F.max("ts") - F.expr("interval 3 days")).alias("cut"))  # one row
    last = log(t).groupBy("thread").agg(F.max("ts").alias("last"), F.count("*").alias("rows")).crossJoin(F.broadcast(cut))
    return last.where("last < cut").select("thread", "rows")


@query(
    "a9_cost_by_intent",
    f"""WITH {LOG}, c AS (SELECT CASE intent WHEN 'error' THEN '未标注' WHEN 'signup' THEN '未标注' ELSE intent END AS intent, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM log GROUP BY 1),
p AS (SELECT *, round(tokens / sum(tokens) OVER (), 4) AS share, row_number() OVER (ORDER BY tokens DESC, intent)::INTEGER AS place FROM c) SELECT *, place = 1 AND intent <> '未标注' AS top FROM p""",
)
def a9(t: Tables) -> DataFrame:
    """Calls carry tags; errors have none of an intent and signups an empty one."""
    tag = F.when(F.col("intent") == "signup", "intent:").when(F.col("intent") != "error", F.concat(F.lit("intent:"), F.col("intent")))
    tags = F.array_compact(F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), tag, F.lit("intent:late")))
    tags = F.when(F.col("intent") == "error", F.slice(tags, 1, 1)).otherwise(tags)
    return A.cost_by_intent(log(t).withColumn("tags", tags), "tags", "tokens")


@query("a10_tokens_by_request", f"WITH {LOG} SELECT thread, intent, sum(tokens)::BIGINT AS tokens, sum(tokens // 3)::BIGINT AS output_tokens, count(*)::BIGINT AS calls FROM log GROUP BY ALL")
def a10(t: Tables) -> DataFrame:
    return log(t).groupBy("thread", "intent").agg(F.sum("tokens").alias("tokens"), F.sum(F.floor(F.col("tokens") / 3)).alias("output_tokens"), F.count("*").alias("calls"))


@query("a11_over_budget", f"WITH {LOG} SELECT thread, sum(tokens)::BIGINT AS tokens, sum(tokens) > 50000 AS over FROM log GROUP BY thread")
def a11(t: Tables) -> DataFrame:
    return log(t).groupBy("thread").agg(F.sum("tokens").alias("tokens")).withColumn("over", F.col("tokens") > 50_000)


ANCHORED_SQL = f"""WITH {anchored_sql('SELECT user_id AS k, event_id, epoch_us(ts) AS us FROM events', 3600)}
SELECT k AS user_id, event_id, start AS window_start, row_number() OVER (PARTITION BY k, start ORDER BY us, event_id) AS nth, nth > 3 AS over FROM w"""


@query("a12_anchored_windows", ANCHORED_SQL)
def a12(t: Tables) -> DataFrame:
    return A.anchored_windows(t.events, "user_id", "ts", "event_id", seconds=3600, limit=3)


@query("a12_tumbling_windows", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, count(*)::BIGINT AS n, count(*) > 3 AS over FROM events GROUP BY ALL")
def a12_tumbling(t: Tables) -> DataFrame:
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour").start
    counts = t.events.groupBy("user_id", F.unix_micros(hour).alias("window_us")).agg(F.count("*").alias("n"))
    return counts.withColumn("over", F.col("n") > 3)


COST = "length(text) * 0.25::DOUBLE + 4"


@query("a13_token_estimate", f"SELECT conv_id, floor(round(sum({COST}), 6))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def a13(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.floor(F.round(F.sum(X.token_estimate(F.col("text"))), 6)).alias("tokens"))


TURNS = f"""g AS (SELECT conv_id, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS group_no FROM conversations),
c AS (SELECT conv_id, group_no::BIGINT AS group_no, sum({COST}) AS cost FROM g GROUP BY ALL)"""


@query(
    "a14_budget_window",
    f"WITH {TURNS} SELECT conv_id, group_no, round(sum(cost) OVER w, 6) AS total, sum(cost) OVER w <= 400 OR row_number() OVER w = 1 AS kept FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY group_no DESC)",
)
def a14(t: Tables) -> DataFrame:
    """Turns by user message; the newest ones that fit the budget stay whole, older ones are to be summarised."""
    groups = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    costs = t.conversations.withColumn("group_no", groups).groupBy("conv_id", "group_no").agg(F.sum(X.token_estimate(F.col("text"))).alias("cost"))
    return A.budget(costs, "conv_id", "group_no", "cost", 400).select("conv_id", "group_no", "total", "kept")


@query(
    "a15_turn_taking",
    """WITH RECURSIVE h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, regexp_matches(coalesce(text, ''), '[0-9]{3}|th') AS named,
  CASE length(coalesce(text, '')) % 4 WHEN 0 THEN 'summary' WHEN 1 THEN 'compare' ELSE 'simple_qa' END AS intent FROM conversations),
f AS (SELECT conv_id, i, turn, named, intent AS final_intent, false AS needs_rewrite FROM h WHERE i = 1 UNION ALL
  SELECT h.conv_id, h.i, h.turn, h.named, CASE WHEN h.intent = 'simple_qa' AND h.named AND f.final_intent <> 'simple_qa' THEN f.final_intent ELSE h.intent END, NOT h.named OR f.final_intent <> 'simple_qa'
  FROM f JOIN h ON h.conv_id = f.conv_id AND h.i = f.i + 1) SELECT conv_id, turn, final_intent, needs_rewrite FROM f""",
)
def a15(t: Tables) -> DataFrame:
    """Turns that refer to the task before them inherit it; others that need their context are to be rewritten."""
    n = F.length(F.coalesce("text", F.lit(""))) % 4
    turns = t.conversations.withColumn("intent", F.when(n == 0, "summary").when(n == 1, "compare").otherwise("simple_qa"))
    out = A.turn_taking(turns, "conv_id", "turn", "text", "intent", ("summary", "compare"), other="simple_qa", has_id="[0-9]{3}|th")
    return out.select("conv_id", "turn", "final_intent", "needs_rewrite")


@query(
    "a16_accept_output",
    """WITH a AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations), h AS (SELECT * FROM a WHERE role = 'assistant' AND asked IS NOT NULL),
x AS (SELECT conv_id, turn, 'rewrite' AS kind, text, asked, trim(text) AS said FROM h
  UNION ALL SELECT conv_id, turn, 'translation', text, asked, CASE WHEN conv_id % 4 = 0 THEN trim(text || repeat('文', length(text) // 3)) ELSE trim(text) END FROM h
  UNION ALL SELECT conv_id, turn, 'intent', text, asked, CASE turn WHEN 1 THEN 'simple_qa' WHEN 3 THEN 'Simple_qa' WHEN 5 THEN '' ELSE 'group_report' END FROM h)
SELECT conv_id, turn, kind, CASE WHEN said = '' THEN 'empty' WHEN kind = 'intent' THEN CASE WHEN said IN ('simple_qa', 'group_report') THEN 'accepted' ELSE 'unknown' END
  WHEN kind = 'rewrite' THEN CASE WHEN length(said) > 5 * length(asked) + 50 THEN 'too_long' ELSE 'accepted' END
  WHEN length(said) > 4 * length(asked) + 80 THEN 'too_long' WHEN conv_id % 4 = 0 AND length(text) // 3 >= 0.15 * length(said) THEN 'not_translated' ELSE 'accepted' END AS verdict FROM x""",
)
def a16(t: Tables) -> DataFrame:
    """Each answer as a rewrite and as a translation of what was asked (in quotes; every fourth conversation's half in Chinese), and a name
    of an intent beside it."""
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    said = t.conversations.withColumn("asked", asked).where("role = 'assistant' and asked is not null")
    told = F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.expr("repeat('文', length(text) div 3)"))).otherwise(F.concat(F.lit(' "'), F.trim("text"), F.lit('" ')))
    intent = F.when(F.col("turn") == 1, "simple_qa").when(F.col("turn") == 3, "Simple_qa").when(F.col("turn") == 5, " ").otherwise("group_report")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("said")) for k, v in (("rewrite", F.col("text")), ("translation", told), ("intent", intent))])
    rows = said.select("conv_id", "turn", "asked", F.inline(kinds))
    return rows.select("conv_id", "turn", "kind", A.accepted(F.col("kind"), F.col("asked"), F.col("said")).alias("verdict"))


MESSAGE = "CASE WHEN event_type <> 'error' THEN 'ok' WHEN value < 20 THEN 'Error code: 429' WHEN value < 40 THEN 'Request timed out' WHEN value < 60 THEN 'Connection refused' ELSE 'boom' END"


@query(
    "a17_error_classes",
    "SELECT CASE WHEN value < 20 THEN 'model_rate_limit' WHEN value < 40 THEN 'timeout_error' WHEN value < 60 THEN 'retrieval_error' ELSE 'internal_error' END AS error_type, count(*)::BIGINT AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
)
def a17(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select(F.expr(MESSAGE).alias("message"))
    return errors.groupBy(A.error_class(F.col("message")).alias("error_type")).agg(F.count("*").alias("n"))


@query("a18_route_mix", "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'planner_agent' ELSE 'tool_agent' END AS route, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def a18(t: Tables) -> DataFrame:
    routes = t.spark.createDataFrame([("purchase", "planner_agent"), ("signup", "planner_agent")], "event_type string, route string")  # a fixed table
    routed = t.events.join(F.broadcast(routes), "event_type", "left")
    return routed.groupBy(F.coalesce("route", F.lit("tool_agent")).alias("route")).agg(F.count("*").alias("n"))


@query(
    "a19_overview",
    """SELECT 'documents' AS metric, NULL AS kind, count(*)::BIGINT AS value FROM documents UNION ALL SELECT 'chunks', NULL, sum(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)))::BIGINT FROM documents
UNION ALL SELECT 'parents', NULL, count(text)::BIGINT FROM documents UNION ALL SELECT 'manifest', NULL, count(DISTINCT doc_id)::BIGINT FROM labels UNION ALL SELECT 'set', role, count(*)::BIGINT FROM conversations GROUP BY role
UNION ALL SELECT 'last_load_us', NULL, epoch_us(max(ts)) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'newest_result', event_type, max_by(event_id, (ts, event_id)) FROM events GROUP BY event_type""",
)
def a19(t: Tables) -> DataFrame:
    """Counts of what there is, the last load, the sizes of the sets and the newest result of each kind, in long form."""
    one = lambda metric, df, what, by=None: (df.groupBy(by) if by else df.groupBy()).agg(what.cast("long").alias("value")).select(F.lit(metric).alias("metric"), F.col(by).alias("kind") if by else F.lit(None).cast("string").alias("kind"), "value")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0))
    parts = [
        one("documents", t.documents, F.count("*")),
        one("chunks", t.documents.where("text is not null"), F.sum(lines)),
        one("parents", t.documents, F.count("text")),
        one("manifest", t.labels, F.countDistinct("doc_id")),
        one("set", t.conversations, F.count("*"), "role"),
        one("last_load_us", t.events.where("event_type <> 'error'"), F.unix_micros(F.max(F.col("ts").cast("timestamp")))),
        one("newest_result", t.events, F.max_by("event_id", F.struct("ts", "event_id")), "event_type"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "a20_clear_threads",
    """WITH g AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'), n AS (SELECT 'turns' AS part, conv_id AS k FROM conversations UNION ALL SELECT 'checkpoints', user_id FROM events UNION ALL SELECT 'writes', doc_id FROM labels)
SELECT conv_id::VARCHAR AS thread, p AS part, (SELECT count(*) FROM n WHERE part = p AND k = conv_id)::BIGINT AS removed, NULL::BIGINT AS kept FROM g, (VALUES ('turns'), ('checkpoints'), ('writes')) AS v(p)
UNION ALL SELECT NULL, part, NULL, count(*) FILTER (k IS NULL OR k NOT IN (SELECT conv_id FROM g))::BIGINT FROM n GROUP BY part""",
)
def a20(t: Tables) -> DataFrame:
    """Threads with a system turn are cleared: rows of their id leave three tables, with the counts of what went and what stays."""
    gone = t.conversations.where("role = 'system'").select(F.concat(F.lit(" "), F.col("conv_id").cast("string")).alias("thread"))
    kept, removed = A.clear_threads({"turns": (t.conversations, "conv_id"), "checkpoints": (t.events, "user_id"), "writes": (t.labels, "doc_id")}, gone)
    stays = reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("kept")).withColumn("part", F.lit(name)) for name, rows in kept.items()])
    return removed.unionByName(stays, allowMissingColumns=True)
