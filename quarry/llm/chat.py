"""Preference formatting: the longest common turn prefix of two conversations as one prompt, and two masked completions.

Everything is DataFrame operations: the sides of a pair meet by position, the first position at which they differ is a minimum,
and only the turns of one pair are ever gathered. A turn is rendered as `<|role|>`, a line break, its text, a line break,
`<|end|>` and a line break. In a completion the text of an assistant turn and its end marker carry loss, all else does not; a
mask lists `loss:characters` of the runs of its completion, comma-joined.

Defined results: exactly repeated turns count once; turns of the same number follow by role and text; a null text is empty, a
null role is `unknown`; rows without a pair id or a turn number are left out; if one side is a prefix of the other (or equal to
it, or missing) its completion is empty; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import table

TAIL = "\n<|end|>\n"


def positions(turns: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """key, pos (from 1), role and text of every turn, in order."""
    rows = turns.where(F.col(key).isNotNull() & F.col(turn).isNotNull())
    rows = rows.select(key, turn, F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy(turn, "role", "text")).alias("pos"), "role", "text")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TAIL))), "")


def _runs(turns: Column) -> Column:
    """loss:characters of the runs of a rendered completion: the head of each turn, then its text and end."""

    def of(t: Column) -> Column:
        head, rest = F.length(_head(t["role"])), F.length(t["text"]) + len(TAIL)
        loss = F.when(t["role"] == "assistant", F.lit("1:")).otherwise(F.lit("0:"))
        return F.concat(F.lit("0:"), head.cast("string"), F.lit(","), loss, rest.cast("string"))

    return F.array_join(F.transform(turns, of), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """chosen and rejected: key, pos, role, text. key, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    c = chosen.select(key, "pos", F.struct("role", "text").alias("c"))
    r = rejected.select(key, "pos", F.struct("role", "text").alias("r"))
    both = c.join(r, [key, "pos"], "full")
    differs = F.coalesce(F.col("c") != F.col("r"), F.lit(True))
    rows = F.array_sort(F.collect_list(F.struct("pos", "c", "r")))
    pairs = both.groupBy(key).agg(rows.alias("t"), F.min(F.when(differs, F.col("pos"))).alias("first"), F.max("pos").alias("last"))
    pairs = pairs.withColumn("n", F.coalesce(F.col("first") - 1, F.col("last")))
    side = lambda name, keep: F.transform(F.filter("t", lambda x: x[name].isNotNull() & keep(x)), lambda x: x[name])
    after = lambda x: x["pos"] > F.col("n")
    return pairs.select(
        key,
        F.col("n").cast("long").alias("n_prefix"),
        _rendered(side("c", lambda x: x["pos"] <= F.col("n"))).alias("prompt"),
        _rendered(side("c", after)).alias("chosen"),
        _rendered(side("r", after)).alias("rejected"),
        _runs(side("c", after)).alias("chosen_mask"),
        _runs(side("r", after)).alias("rejected_mask"),
    )


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last answer, against itself with the last answer of the conversation of the next id (or none)."""
    turns = positions(table(spark, sf_dir, "conversations"), "conv_id")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("pos", "text")).alias("a"))
    last = last.select("conv_id", F.col("a.pos").alias("at"), F.col("a.text").alias("answer"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"))
    chosen = turns.join(last.join(other, "conv_id", "left"), "conv_id", "left").where("at is null or pos <= at")
    text = F.when(F.col("pos") == F.col("at"), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return preference_pairs(chosen, chosen.withColumn("text", text), "conv_id")


OP2_SQL = """
WITH t0 AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM t0),
l AS (SELECT conv_id, max(pos) AS "at", max_by(text, pos) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT t.conv_id, pos, role, t.text, CASE WHEN pos = l."at" THEN coalesce(o.answer, '') ELSE t.text END AS other FROM t LEFT JOIN l USING (conv_id) LEFT JOIN l o ON o.conv_id = t.conv_id + 1
  WHERE l."at" IS NULL OR pos <= l."at"),
n AS (SELECT conv_id, coalesce(min(pos) FILTER (text <> other) - 1, max(pos)) AS n FROM c GROUP BY conv_id),
r AS (SELECT conv_id, pos, n, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || other || chr(10) || '<|end|>' || chr(10) AS b,
  '0:' || (length(role) + 5)::VARCHAR || ',' || CASE role WHEN 'assistant' THEN '1:' ELSE '0:' END AS m, length(text) + 9 AS x, length(other) + 9 AS y FROM c JOIN n USING (conv_id))
SELECT conv_id, n::BIGINT AS n_prefix, coalesce(string_agg(a, '' ORDER BY pos) FILTER (pos <= n), '') AS prompt, coalesce(string_agg(a, '' ORDER BY pos) FILTER (pos > n), '') AS chosen,
  coalesce(string_agg(b, '' ORDER BY pos) FILTER (pos > n), '') AS rejected, coalesce(string_agg(m || x::VARCHAR, ',' ORDER BY pos) FILTER (pos > n), '') AS chosen_mask,
  coalesce(string_agg(m || y::VARCHAR, ',' ORDER BY pos) FILTER (pos > n), '') AS rejected_mask
FROM r GROUP BY conv_id, n
"""
