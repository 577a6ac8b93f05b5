"""Log and conversation analytics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.anchors import spread_windows

# Error classes by the first rule with a keyword in the lower-cased message.
ERRORS = (
    ("config_error", (".env", "api_key")),
    ("model_auth_error", ("authentication", "invalid api key", "api key", "error code: 401")),
    ("model_permission_error", ("permission", "access denied", "error code: 403")),
    ("model_rate_limit", ("rate limit", "too many requests", "error code: 429")),
    ("timeout_error", ("timeout", "timed out")),
    ("retrieval_error", ("6333", "points/search", "connection refused", "failed to establish")),
    ("embedding_error", ("embedding", "silicon", "20015")),
    ("model_request_error", ("badrequest", "bad request", "error code: 400")),
)
OTHER_ERROR = "internal_error"
# Names of intents, limits of a rewrite and of a translation (times the question's length, and more), its CJK share.
INTENTS = ("simple_qa", "metadata_query", "summary_paper", "summary_ppt", "group_report", "compare_papers")
REWRITE, TRANSLATION, TRANSLATION_CJK = (5, 50), (4, 80), 0.15
TAG, UNLABELLED = "intent:", "未标注"


def accepted(kind: Column, asked: Column, said: Column) -> Column:
    """Why a model's output is refused, or `accepted`, by its kind: a rewrite is empty or too_long; a translation also not_translated
    (CJK characters from 0.15 of it), after quotes around it are gone; an intent is empty or unknown."""
    bare = F.trim(F.coalesce(said, F.lit("")))
    bare = F.when(kind == "translation", F.regexp_replace(F.regexp_replace(bare, '^"+|"+$', ""), "^'+|'+$", "")).otherwise(bare)
    over = lambda limit: F.length(bare) > F.length(asked) * limit[0] + limit[1]
    return (
        F.when(bare == "", "empty")
        .when(kind == "intent", F.when(bare.isin(*INTENTS), "accepted").otherwise("unknown"))
        .when(kind == "rewrite", F.when(over(REWRITE), "too_long").otherwise("accepted"))
        .otherwise(F.when(over(TRANSLATION), "too_long").when(X.cjk_share(bare) >= TRANSLATION_CJK, "not_translated").otherwise("accepted"))
    )


def cost_by_intent(calls: DataFrame, tags: str, tokens: str) -> DataFrame:
    """intent, tokens, calls, share, place and top. The intent is that of the first tag `intent:...`; calls without one are unlabelled.
    The share is null where there are no tokens at all. Top is the intent with most tokens, but an unlabelled one is none."""
    tag = F.get(F.filter(F.col(tags), lambda x: F.startswith(x, F.lit(TAG))), F.lit(0))
    intent = F.coalesce(F.nullif(F.substring(tag, len(TAG) + 1, 1 << 30), F.lit("")), F.lit(UNLABELLED))
    cost = calls.groupBy(intent.alias("intent")).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count("*").alias("calls"))
    total = F.sum("tokens").over(Window.partitionBy())  # these windows run over one row for each intent
    out = cost.withColumn("share", F.when(total > 0, F.round(F.col("tokens") / total, 4))).withColumn("place", F.row_number().over(Window.orderBy(F.desc("tokens"), "intent")))
    return out.withColumn("top", (F.col("place") == 1) & (F.col("intent") != UNLABELLED))


def clear_threads(tables: dict[str, tuple[DataFrame, str]], threads: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (name: rows and their thread column) without the threads, and how many rows of each went: thread, part, removed.
    A blank thread clears nothing; a thread that a table does not have counts 0 there."""
    gone = threads.select(F.trim(F.col("thread").cast("string")).alias("thread")).where("thread <> ''").distinct()
    kept, counts = {}, []
    for name, (rows, column) in tables.items():
        own = F.col(column).cast("string")
        kept[name] = rows.join(gone.withColumnRenamed("thread", "__thread"), own == F.col("__thread"), "left_anti")
        sizes = rows.groupBy(own.alias("thread")).agg(F.count("*").alias("removed"))
        counts.append(gone.join(sizes, "thread", "left").select("thread", F.lit(name).alias("part"), F.coalesce("removed", F.lit(0)).alias("removed")))
    return kept, reduce(DataFrame.unionByName, counts)


def error_class(message: Column) -> Column:
    low = F.lower(message)
    out = None
    for name, words in ERRORS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_ERROR)


FEEDBACK_CHARS = 500


def favourites(events: DataFrame, by: list[str], adds: Column, order: Column) -> DataFrame:
    """Adding twice is adding once; the last event of each user and item decides."""
    last = events.groupBy(*by).agg(F.max_by(adds, order).alias("added"))
    return last.where("added").select(*by)


def feedback(events: DataFrame, score: str, question: str) -> DataFrame:
    """Marks of +1 and -1 only, with the question's first FEEDBACK_CHARS letters."""
    return events.where(F.col(score).isin(1, -1)).withColumn(question, F.left(F.col(question), F.lit(FEEDBACK_CHARS)))


def turn_taking(turns: DataFrame, thread: str, order: str, text: str, intent: str, tasks: tuple[str, ...], *, other: str, has_id: str) -> DataFrame:
    """turns with final_intent and needs_rewrite.

    A turn classed `other` that names an id inherits the intent of the turn before it if that is a task. A turn needs to be rewritten
    if there is one before it, and it names no id or follows a task.
    """
    w = Window.partitionBy(thread).orderBy(order)
    named = F.coalesce(F.col(text).rlike(has_id), F.lit(False))
    follows = (F.col(intent) == other) & named
    # a chain of turns that may inherit has the intent of the turn that it hangs on
    own = F.last_value(F.when(~follows, F.col(intent)), ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    final = F.when(follows & own.isin(*tasks), own).otherwise(F.col(intent))
    out = turns.withColumn("final_intent", final)
    before = F.lag("final_intent").over(w)
    return out.withColumn("needs_rewrite", F.coalesce(before.isNotNull() & (~named | before.isin(*tasks)), F.lit(False)))


def last_turns(turns: DataFrame, thread: str, order: str, n: int) -> DataFrame:
    """The last n turns of each thread, numbered from the oldest of them."""
    back = Window.partitionBy(thread).orderBy(F.desc(order))
    kept = turns.withColumn("__b", F.row_number().over(back)).where(F.col("__b") <= n).drop("__b")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(thread).orderBy(order)))


def owners(events: DataFrame, thread: str, user: str, ts: str, order: str) -> DataFrame:
    """The first user of a thread owns it."""
    return events.groupBy(thread).agg(F.min_by(user, F.struct(ts, order)).alias("owner"), F.max(ts).alias("last_active"))


#: Requests of a key from which on its windows are found by range search and doubled jumps instead of in one task.
FOLDED = 5_000_000


def anchored_windows(events: DataFrame, key: str, ts: str, order: str, *, seconds: int, limit: int, folded: int = FOLDED) -> DataFrame:
    """Fixed windows that begin at the first request after the last window: window_start, nth request in it, over the limit.

    A window's start depends on the window before it. For keys of up to `folded` requests a fold runs over each key's sorted rows, a
    partition being streamed; keys with more are spread over tasks (anchors.py). The result is the same.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0, 0
        for pdf in batches:
            starts, numbers = [], []
            for k, at in zip(pdf[key], pdf["__us"]):
                if k != now or at - start >= seconds * 1_000_000:
                    now, start, n = k, at, 0
                n += 1
                starts.append(start)
                numbers.append(n)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "window_start": starts, "nth": numbers, "over": [i > limit for i in numbers]})

    rows = events.select(key, order, F.expr(f"unix_micros(cast({ts} as timestamp))").alias("__us"))
    hot = [r[0] for r in rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > folded).select(key).collect()]  # rows / folded at most
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    ordered = rows.where(~is_hot).repartition(F.col(key)).sortWithinPartitions(key, "__us", order)
    schema = rows.select(key, order).schema.add("window_start", "long").add("nth", "long").add("over", "boolean")
    out = ordered.mapInPandas(fold, schema)
    return out.unionByName(spread_windows(rows.where(is_hot), key, "__us", order, seconds=seconds, limit=limit)) if hot else out


def budget(turns: DataFrame, thread: str, order: str, cost: str, most: float) -> DataFrame:
    """Which turns of a thread fit the budget, counted from the newest; the first one that does not fit ends it."""
    newest = Window.partitionBy(thread).orderBy(F.desc(order))
    total = F.sum(cost).over(newest)
    last = F.row_number().over(newest) == 1  # the current turn always stays whole
    return turns.withColumn("total", F.round(total, 6)).withColumn("kept", (total <= most) | last)
