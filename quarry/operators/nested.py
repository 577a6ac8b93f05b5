"""Text out of JSON content of any depth, level by level as VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import stored


def inline_text(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key and text: all strings of the JSON text in column content, in their order and without anything between them.

    A string is itself. A list is the text of its items: of an object that of its member `content`, of a list that of the list, of
    any other value the value as text. Content that is an object, a number or null, or that is no JSON, has the empty text. Keys
    are unique. Each round takes one level off what is still a list, so a table takes as many rounds as its deepest value has lists.
    """
    level = rows.select(key, F.array().cast("array<int>").alias("path"), F.try_parse_json(content).alias("v"), F.lit(False).alias("item"))
    leaves = [level.select(key, "path", F.lit(None).cast("string").alias("text"))]  # so that every key has a row
    while True:
        values = F.try_variant_get("v", "$", "array<variant>")
        plain = values.isNull() & F.try_variant_get("v", "$", "map<string,variant>").isNull()
        shown = plain & (F.col("item") | (F.schema_of_variant("v") == "STRING"))
        leaves.append(level.where(shown).select(key, "path", F.try_variant_get("v", "$", "string").alias("text")))
        inner = level.where(values.isNotNull()).select(key, "path", F.posexplode(values).alias("i", "v"))
        member = F.try_variant_get("v", "$", "map<string,variant>")
        inner = inner.select(
            key, F.concat("path", F.array("i")).alias("path"), F.when(member.isNotNull(), F.try_element_at(member, F.lit("content"))).otherwise(F.col("v")).alias("v"), member.isNull().alias("item")
        )
        level = stored(inner, "nested")
        if not level.limit(1).count():
            break
    parts = reduce(DataFrame.unionByName, leaves).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("parts"))
    return parts.select(key, F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
