"""Corpus building: blocks, sections, child chunks and parent chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

# Block kinds, labels and limits of the corpus model.
DROPPED = ("header", "footer", "page_number")
FRONT = "（前置内容）"
PARENT_CHARS = 3500
#: Bytes of texts that a task has as Python objects at once (one text at least).
SLICE = 1 << 20
NOISE = (
    "reference", "参考文献", "（前置内容）", "front matter", "acknowledg", "致谢", "author contribution", "作者贡献", "competing interest",
    "利益冲突", "data availability", "数据可用性", "additional information", "supplementary", "附录", "funding", "基金",
)
CAPTION = "(?i)^\\s*(figure|fig\\.?|table)\\s*(\\d{1,3})"


# Kinds of office blocks and what stands for blocks without text.
HEADING_KINDS = tuple(f"heading{i}" for i in range(1, 10))
TEXT_KINDS = ("text", "bullet", "ordered", "code", "quote", "todo", "callout")
ATTACHMENT_KINDS = ("image", "file", "media")
BULLET, NO_TABLE, ATTACHMENT, NO_DOCUMENT = "• ", "[表格]", "[图片或附件]", "[空文档]"
_RUNS = "struct<elements: array<struct<text_run: struct<content: string>, equation: struct<content: string>>>>"
CLAIMS, CLAIM_CHARS, CONFIDENCE = 4, 200, ("high", "medium", "low")


def office_blocks(rows: DataFrame, key: str, order: str, block: str) -> DataFrame:
    """Office blocks as JSON become key, order, block_type and text.

    A block has one key for its kind: headings, kinds of text (bullets get a mark), tables, attachments. Blocks of text without any
    are dropped; a document of which nothing is left has one block that says so.
    """
    kinds = [*HEADING_KINDS, *TEXT_KINDS, "table"]
    b = F.from_json(block, ", ".join(f"{k} {_RUNS}" for k in kinds) + ", " + ", ".join(f"{k} string" for k in ATTACHMENT_KINDS))
    runs = lambda c: F.trim(F.array_join(F.transform(c["elements"], lambda e: F.coalesce(e["text_run"]["content"], e["equation"]["content"], F.lit(""))), ""))
    blank = lambda c: F.nullif(F.coalesce(runs(c), F.lit("")), F.lit(""))
    made = lambda kind, text: F.struct(F.lit(kind).alias("block_type"), text.alias("text"))
    found = None
    for kind in kinds:
        c = F.col("b")[kind]
        if kind in HEADING_KINDS:
            out = made("heading", blank(c))
        elif kind == "table":
            out = made("table", F.coalesce(blank(c), F.lit(NO_TABLE)))
        else:
            out = made("text", F.concat(F.lit(BULLET), blank(c)) if kind == "bullet" else blank(c))
        found = F.when(c.isNotNull(), out) if found is None else found.when(c.isNotNull(), out)
    attached = F.lit(False)
    for kind in ATTACHMENT_KINDS:
        attached = attached | F.col("b")[kind].isNotNull()
    found = found.when(attached, made("text", F.lit(ATTACHMENT)))
    parsed = rows.select(key, order, b.alias("b")).select(key, order, found.alias("x")).select(key, order, "x.block_type", "x.text")
    kept = parsed.where("text is not null")
    empty = rows.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")
    none = empty.select(key, F.lit(None).cast(dict(rows.dtypes)[order]).alias(order), F.lit("text").alias("block_type"), F.lit(NO_DOCUMENT).alias("text"))
    return kept.unionByName(none)


def caption_facts(said: Column) -> Column:
    """summary, claims and confidence from a model's answer, or null: the outermost braces, in a fence or not, hold JSON with a summary
    and a list of claims, of which the first CLAIMS count, cut to CLAIM_CHARS letters. An unknown confidence is medium."""
    body = F.regexp_extract(said, "(?s)(\\{.*\\})", 1)
    x = F.from_json(body, "summary string, key_claims string, confidence string")
    claims = F.from_json(x["key_claims"], "array<string>")
    confidence = F.when(x["confidence"].isin(*CONFIDENCE), x["confidence"]).otherwise("medium")
    short = F.slice(F.transform(claims, lambda c: F.left(c, F.lit(CLAIM_CHARS))), 1, CLAIMS)
    usable = (F.coalesce(x["summary"], F.lit("")) != "") & F.startswith(x["key_claims"], F.lit("[")) & claims.isNotNull()
    return F.when(usable, F.struct(x["summary"].alias("summary"), short.alias("claims"), confidence.alias("confidence")))


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Drops page furniture and empty blocks; paragraph_title becomes section_title, image becomes figure."""
    kind = F.when(F.col("block_type") == "paragraph_title", "section_title").when(F.col("block_type") == "image", "figure").otherwise(F.col("block_type"))
    kept = blocks.where(~F.col("block_type").isin(*DROPPED)).withColumn("block_type", kind).withColumn("text", X.blank(F.col("text")))
    return kept.where("length(text) > 0")


def pick(parts: Column, kind: str) -> Column:
    """The first part of a kind, or null."""
    return F.try_element_at(F.filter(parts, lambda x: x["type"] == kind), F.lit(1))


def caption_label(c: Column) -> Column:
    """`Figure 3` or `Table 2` from the start of a caption, or null."""
    kind, number = F.regexp_extract(c, CAPTION, 1), F.regexp_extract(c, CAPTION, 2)
    return F.when(number != "", F.concat(F.when(F.lower(kind) == "table", "Table ").otherwise("Figure "), number))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def merge_continued(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbouring text blocks of which the later one continues the earlier become one (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    goes_on = F.col("continues") & (F.lag("block_type").over(w) == F.col("block_type")) & F.col("block_type").isin("text", "ref_text")
    marked = blocks.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    return marked.groupBy(key, "island").agg(
        F.first("block_type").alias("block_type"), F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"), F.count("*").alias("n_blocks")
    )


def sections(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Blocks with section_no and section, the text of the last section title before them; titles are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    title = F.col("block_type") == "section_title"
    out = blocks.withColumn("section_no", F.sum(F.when(title, 1).otherwise(0)).over(w))
    out = out.withColumn("section", F.coalesce(F.last(F.when(title, F.col("text")), ignorenulls=True).over(w), F.lit(FRONT)))
    return out.where(~title & (F.col("block_type") != "doc_title"))


def reference_sections(blocks: DataFrame, key: str) -> DataFrame:
    """Per section: is it a list of references, by its name or by the share of reference blocks?"""
    share = F.avg(F.when(F.col("block_type") == "ref_text", 1.0).otherwise(0.0))
    return blocks.groupBy(key, "section_no", "section").agg((F.contains(F.lower(F.col("section")), F.lit("references")) | (share > 0.6)).alias("is_reference"))


_CJK = regex.compile("[一-鿿]")
_MARK = regex.compile(X.PUNCTUATION.replace("\\[", "\\["))
_END = regex.compile(X.SENTENCE_END, regex.V1)


def _weight(text: str) -> tuple[int, int]:
    return len(_CJK.findall(text)), len(_MARK.findall(text))


def _limit(length: int, cjk: int, marks: int) -> int:
    if not length:
        return X.EMPTY_LIMIT
    each = (cjk * X.TOKENS_CJK + max(0, length - cjk - marks) * X.TOKENS_LATIN + marks * X.TOKENS_PUNCTUATION) / length
    return max(X.LEAST_LIMIT, int(X.MAX_TOKENS * X.SAFETY / each))


def pack_sentences(text: str) -> list[str]:
    """Sentences joined greedily while the joined text keeps within its own limit; longer sentences are cut at theirs.

    The limit depends on the characters of the candidate, so counts are carried along: the fold reads each sentence once.
    """
    out: list[str] = []
    now, length, cjk, marks = [], 0, 0, 0
    for sentence in (s.strip() for s in _END.split(" ".join(text.split()))):
        if not sentence:
            continue
        c, m = _weight(sentence)
        joined = length + len(sentence) + (1 if now else 0)
        if now and joined > _limit(joined, cjk + c, marks + m):
            out.append(" ".join(now))
            now, length, cjk, marks = [], 0, 0, 0
            joined = len(sentence)
        if len(sentence) > (most := _limit(len(sentence), c, m)):
            if now:
                out.append(" ".join(now))
            out += [sentence[i : i + most] for i in range(0, len(sentence), most)]
            now, length, cjk, marks = [], 0, 0, 0
            continue
        now.append(sentence)
        length, cjk, marks = joined, cjk + c, marks + m
    if now:
        out.append(" ".join(now))
    return out


def children(sectioned: DataFrame, key: str, order: str) -> DataFrame:
    """Child chunks of every document: key, seq (from 1 across sections), section_no, section, text.

    The text blocks of a section are put together by Spark; only the fold over its sentences runs in Python, on one section at
    a time, so a document of any length is a stream of its sections.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    whole = sectioned.where("block_type = 'text'").groupBy(key, "section_no", "section").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for each in batches for part in _cut(each, "text")):
            chunks = [pack_sentences(x.as_py() or "") for x in batch.column("text")]
            at = pa.array([i for i, c in enumerate(chunks) for _ in c], pa.int32())
            own = [batch.column(c).take(at) for c in (key, "section_no", "section")]
            pos, text = pa.array([i for c in chunks for i in range(len(c))], pa.int32()), pa.array([x for c in chunks for x in c], pa.string())
            yield pa.RecordBatch.from_arrays([*own, pos, text], names=[key, "section_no", "section", "pos", "text"])

    kind = whole.select(key, "section_no", "section", F.lit(0).alias("pos"), "text").schema
    parts = whole.select(key, "section_no", "section", "text").mapInArrow(packed, kind)
    return parts.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("section_no", "pos"))).drop("pos")


def _cut(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about SLICE bytes of a column, or one row that is longer."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def parents(chunks: DataFrame, key: str) -> DataFrame:
    """chunks with parent_no: children of one section packed in order while their characters, 2 more each, fit PARENT_CHARS.

    The fold reads keys and lengths; the chunks' other columns go through as they are."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None
        for batch in (part for each in batches for part in _cut(each, "text")):
            numbers = []
            for item, section, size in zip(*(c.to_pylist() for c in (batch.column(key), batch.column("section_no"), pc.utf8_length(batch.column("text"))))):
                if state is None or state[0] != item:
                    state = (item, section, 1, size + 2)
                elif state[1] != section or state[3] + size + 2 > PARENT_CHARS:
                    state = (item, section, state[2] + 1, size + 2)
                else:
                    state = (item, section, state[2], state[3] + size + 2)
                numbers.append(state[2])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "parent_no"])

    ordered = chunks.repartition(F.col(key)).sortWithinPartitions(key, "seq")
    return ordered.mapInArrow(fold, chunks.schema.add("parent_no", "long"))


def usable(section: Column, block_type: Column, text: Column, is_reference: Column) -> Column:
    """Chunks fit to ask questions about."""
    name = F.trim(F.coalesce(section, F.lit("")))
    noise = F.lower(name).rlike("|".join(NOISE))
    return ~is_reference & ~block_type.isin("equation", "figure") & (F.length(X.blank(text)) >= 200) & (F.length(name) <= 40) & ~noise


def embed_text(kind: Column, caption: Column, text: Column) -> Column:
    """Text to embed: tables as caption and stripped text; cut to its limit and to 1000; a space if there is none."""
    body = F.when(kind == "table", F.concat_ws("\n", caption, X.strip_table(text))).otherwise(text)
    body = X.blank(F.coalesce(body, F.lit("")))
    cut = F.left(body, F.least(F.lit(1000), X.char_limit(body)))
    return F.when(F.trim(cut) == "", " ").otherwise(cut)
