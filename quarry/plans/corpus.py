"""Corpus queries: the lines of `documents` are blocks (short ones titles), `pages` give headings and table HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import build as B
from quarry.operators.nested import inline_text
from quarry.operators.ranks import running
from quarry.operators.sync import upsert
from quarry.plans.base import Tables, query

BLOCKS = """
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
b0 AS (SELECT doc_id, i AS ord, ls[i] AS text FROM l, unnest(range(1, len(ls) + 1)) AS r(i)),
b AS (SELECT doc_id, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text,
  CASE WHEN length(text) < 40 AND text NOT LIKE '%|%' THEN 'section_title' WHEN text LIKE '%|%' THEN 'table' ELSE 'text' END AS block_type FROM b0)"""
KEPT = BLOCKS + ", k AS (SELECT * FROM b WHERE length(text) > 0)"
SECT = KEPT + """, s0 AS (SELECT *, sum(CASE WHEN block_type = 'section_title' THEN 1 ELSE 0 END) OVER w AS section_no,
  coalesce(last_value(CASE WHEN block_type = 'section_title' THEN text END IGNORE NULLS) OVER w, '（前置内容）') AS section
  FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
s AS (SELECT * FROM s0 WHERE block_type <> 'section_title')"""


def blocks(t: Tables) -> DataFrame:
    lines = t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    kind = F.when((F.length("text") < 40) & ~F.contains("text", F.lit("|")), "paragraph_title").when(F.contains("text", F.lit("|")), "table").otherwise("text")
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("ord"), "text", kind.alias("block_type"))


def normalized(t: Tables) -> DataFrame:
    return B.normalize_blocks(blocks(t))


def sectioned(t: Tables) -> DataFrame:
    return B.sections(normalized(t), "doc_id", "ord")


@query(
    "c1_inline_text",
    "SELECT conv_id, string_agg(CASE WHEN turn % 4 = 3 THEN '' ELSE text END || CASE WHEN turn % 4 = 2 THEN turn::VARCHAR ELSE '' END, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
)
def c1(t: Tables) -> DataFrame:
    """Content in all its forms (the turns of a conversation are the items): strings, objects, lists of objects, lists in lists with
    numbers between; an object as content has no text."""
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("content")))
    quoted = F.regexp_extract(said, '(?s)"content":(.*)}$', 1)  # the text as a JSON string
    fill = lambda form, *cols: F.format_string(form, *cols)
    form = (
        F.when(F.col("turn") % 4 == 0, quoted)
        .when(F.col("turn") % 4 == 1, fill('{"type":"p","content":[%s]}', said))
        .when(F.col("turn") % 4 == 2, fill('{"content":[[%s,[{"content":[[],%d]}]]]}', quoted, F.col("turn")))
        .otherwise(fill('{"type":"note","content":{"content":%s}}', quoted))
    )
    items = F.array_sort(F.collect_list(F.struct("turn", "text", form.alias("form"))))
    contents = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["form"]), ","), F.lit("]")).alias("content"))
    return inline_text(contents, "conv_id", "content")


@query("c2_normalize_blocks", f"WITH {KEPT} SELECT doc_id, ord, block_type, text FROM k")
def c2(t: Tables) -> DataFrame:
    return normalized(t).select("doc_id", "ord", "block_type", "text")


@query("c3_pick_part", f"WITH {KEPT} SELECT doc_id, min_by(text, ord) FILTER (block_type = 'table') AS first_table, min_by(text, ord) FILTER (block_type = 'text') AS first_text FROM k GROUP BY doc_id")
def c3(t: Tables) -> DataFrame:
    parts = normalized(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("block_type").alias("type"), "text"))).alias("parts"))
    return parts.select("doc_id", *[B.pick(F.col("parts"), k)["text"].alias(f"first_{k}") for k in ("table", "text")])


CAPTIONS = "c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'fig. ' ELSE 'Table ' END || (page_id % 120)::VARCHAR || ' ' || url AS caption FROM pages)"


def captions(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "Figure ").when(F.col("page_id") % 3 == 1, "fig. ").otherwise("Table ")
    return t.pages.withColumn("caption", F.concat(kind, (F.col("page_id") % 120).cast("string"), F.lit(" "), F.col("url")))


@query("c4_caption_label", f"WITH {CAPTIONS} SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'Table ' ELSE 'Figure ' END || (page_id % 120)::VARCHAR AS label FROM c")
def c4(t: Tables) -> DataFrame:
    return captions(t).select("page_id", B.caption_label(F.col("caption")).alias("label"))


AREA = "round(greatest(0, embedding[3]::DOUBLE - embedding[1]::DOUBLE) * greatest(0, embedding[4]::DOUBLE - embedding[2]::DOUBLE), 9)"


def boxes(t: Tables) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return t.embeddings.withColumn("area", F.round(B.box_area(*e), 9))


@query("c5_box_area", f"SELECT vec_id, {AREA} AS area FROM embeddings")
def c5(t: Tables) -> DataFrame:
    return boxes(t).select("vec_id", "area")


@query(
    "c6_merge_continued",
    f"""WITH {KEPT}, m AS (SELECT *, CASE WHEN regexp_matches(text, '^[a-zà-ÿ]') AND lag(block_type) OVER w = block_type AND block_type = 'text' THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM m)
SELECT doc_id, island::BIGINT AS island, min(block_type) AS block_type, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5, count(*)::BIGINT AS n_blocks FROM i GROUP BY doc_id, island""",
)
def c6(t: Tables) -> DataFrame:
    """A block that begins in lower case continues the text block before it."""
    merged = B.merge_continued(normalized(t).withColumn("continues", F.col("text").rlike("^[a-zà-ÿ]")), "doc_id", "ord")
    return merged.select("doc_id", "island", "block_type", F.md5("text").alias("text_md5"), "n_blocks")


@query(
    "c7_figure_filter",
    f"SELECT vec_id, label, area, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS number FROM (SELECT vec_id, label, {AREA} AS area FROM embeddings) WHERE area >= 0.02",
)
def c7(t: Tables) -> DataFrame:
    """Figures that are large enough, numbered within their item."""
    return running(boxes(t).where("area >= 0.02"), ["label"], [F.col("vec_id").asc()], rank="number").select("vec_id", "label", "area", "number")


@query(
    "c8_office_blocks",
    """WITH b AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 6 ELSE (conv_id + turn) % 8 END AS k, trim(regexp_replace(text, '\\s', ' ', 'g')) AS t FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 0 THEN 'heading' WHEN k = 4 THEN 'table' ELSE 'text' END AS block_type,
  CASE k WHEN 1 THEN '• ' || t || '=x' WHEN 4 THEN CASE WHEN turn % 2 = 0 THEN '[表格]' ELSE t || '=x' END WHEN 5 THEN '[图片或附件]' WHEN 6 THEN NULL ELSE t || '=x' END AS text FROM b)
SELECT * FROM x WHERE text IS NOT NULL UNION ALL SELECT conv_id, NULL, 'text', '[空文档]' FROM x GROUP BY conv_id HAVING count(text) = 0""",
)
def c8(t: Tables) -> DataFrame:
    """Blocks of several kinds made of turns: headings, text, bullets, tables, attachments, blank ones and unknown ones."""
    k = F.when(F.col("conv_id") % 5 == 0, 6).otherwise((F.col("conv_id") + F.col("turn")) % 8)
    kind = F.when(k == 0, F.concat(F.lit("heading"), (F.col("turn") % 9 + 1).cast("string"))).when(k == 1, "bullet").when(k == 2, "ordered").when(k == 3, "code").when(k == 4, "table").when(k == 5, "image").when(k == 6, "callout").otherwise("todo")
    text = F.trim(F.regexp_replace("text", "\\s", " "))
    empty = (k == 6) | ((k == 4) & (F.col("turn") % 2 == 0))
    run = F.struct(F.struct(F.concat(F.lit(" "), text).alias("content")).alias("text_run"))
    formula = F.struct(F.struct(F.lit("=x ").alias("content")).alias("equation"))
    elements = F.when(empty, F.lit("[]")).otherwise(F.concat(F.lit("["), F.to_json(run), F.lit(","), F.to_json(formula), F.lit("]")))
    block = F.concat(F.lit('{"block_id":"b","'), kind, F.lit('":{"elements":'), elements, F.lit("}}"))
    return B.office_blocks(t.conversations.select("conv_id", "turn", block.alias("block")), "conv_id", "turn", "block")


@query("c9_content_hash", f"WITH {KEPT} SELECT doc_id, sha256(string_agg(block_type || chr(31) || text, chr(30) ORDER BY ord)) AS content_hash FROM k GROUP BY doc_id")
def c9(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("\x1f", "block_type", "text").alias("x"))))
    return normalized(t).groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), "\x1e"), 256).alias("content_hash"))


@query("c10_sections", f"WITH {SECT} SELECT doc_id, ord, section_no::BIGINT AS section_no, section FROM s")
def c10(t: Tables) -> DataFrame:
    return sectioned(t).select("doc_id", "ord", "section_no", "section")


REFS = SECT + """, r AS (SELECT doc_id, section_no, section, contains(lower(section), 'references') OR avg(CASE WHEN regexp_matches(text, '(http|doi|[0-9]{4})') THEN 1.0 ELSE 0.0 END) > 0.6 AS is_reference FROM s GROUP BY doc_id, section_no, section)"""


def reference_marked(t: Tables) -> DataFrame:
    marked = sectioned(t).withColumn("block_type", F.when(F.col("text").rlike("(http|doi|[0-9]{4})"), "ref_text").otherwise(F.col("block_type")))
    return B.reference_sections(marked, "doc_id")


@query("c11_reference_sections", f"WITH {REFS} SELECT doc_id, section_no::BIGINT AS section_no, is_reference FROM r")
def c11(t: Tables) -> DataFrame:
    return reference_marked(t).select("doc_id", "section_no", "is_reference")


SENT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([。！？；])', '\1' || chr(1), 'g'), '([.!?])(\s+)([A-Z0-9(\[])', '\1' || chr(1) || '\2\3', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


@query("c12_sentences", f"SELECT doc_id, len({SENT})::BIGINT AS n, md5(array_to_string({SENT}, chr(10))) AS sentences_md5 FROM documents WHERE text IS NOT NULL")
def c12(t: Tables) -> DataFrame:
    s = t.documents.where("text is not null").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


PUNCT = r"""'[.,;:()\[\]{}"''`~!?@#$%^&*+=<>/\\|_–—‘’“”…]'"""
LIMIT = f"""CASE WHEN coalesce(length(text), 0) = 0 THEN 1434 ELSE greatest(120, floor(512 * 0.94::DOUBLE / (((length(text) - length(regexp_replace(text, {PUNCT}, '', 'g'))) * 1.3::DOUBLE
  + length(regexp_replace(text, {PUNCT}, '', 'g')) * 0.39::DOUBLE) / length(text)))::INTEGER) END"""


@query("c13_char_limit", f"SELECT doc_id, {LIMIT} AS char_limit FROM documents")
def c13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.char_limit(F.col("text")).alias("char_limit"))


def _limit_sql(n: str, cjk: str, marks: str) -> str:
    each = f"({cjk} * {X.TOKENS_CJK}::DOUBLE + greatest(0, {n} - {cjk} - {marks}) * {X.TOKENS_LATIN}::DOUBLE + {marks} * {X.TOKENS_PUNCTUATION}::DOUBLE) / {n}"
    return f"CASE WHEN {n} = 0 THEN {X.EMPTY_LIMIT} ELSE greatest({X.LEAST_LIMIT}, floor({X.MAX_TOKENS} * {X.SAFETY}::DOUBLE / ({each}))::BIGINT) END"


#: Child chunks, a step of the recursion for each sentence of a section: `done` chunks are full, and the one that is being filled has
#: `held` sentences of `size` characters. A sentence is in chunk `first`; a cut one goes on to chunk `done`.
CHILDREN = f"""RECURSIVE {SECT.lstrip()}, whole AS (SELECT doc_id, section_no, section, string_agg(text, ' ' ORDER BY ord) AS text FROM s WHERE block_type = 'text' GROUP BY ALL),
cut AS (SELECT doc_id, section_no, {SENT} AS parts FROM whole),
sent AS MATERIALIZED (SELECT doc_id, section_no, i, t, length(t) AS n, length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')) AS c, length(t) - length(regexp_replace(t, {PUNCT}, '', 'g')) AS m
  FROM (SELECT doc_id, section_no, i, parts[i] AS t FROM cut, unnest(range(1, len(parts) + 1)) AS r(i))),
fold AS (SELECT doc_id, section_no, 0::BIGINT AS i, 0::BIGINT AS first, 0::BIGINT AS done, 0::BIGINT AS held, 0::BIGINT AS size, 0::BIGINT AS cjk, 0::BIGINT AS marks, false AS long, 0::BIGINT AS own FROM whole
UNION ALL SELECT doc_id, section_no, i, done + 1, CASE WHEN long THEN done + ceil(n / own)::BIGINT ELSE done END, CASE WHEN long THEN 0 ELSE held + 1 END, CASE WHEN long THEN 0 ELSE size END,
  CASE WHEN long THEN 0 ELSE cjk + c END, CASE WHEN long THEN 0 ELSE marks + m END, long, own
  FROM (SELECT doc_id, section_no, i, n, c, m, own, n > own AS long, done + (held > 0 AND (flush OR n > own))::BIGINT AS done, CASE WHEN flush THEN 0 ELSE held END AS held,
      CASE WHEN flush THEN n ELSE joined END AS size, CASE WHEN flush THEN 0 ELSE cjk END AS cjk, CASE WHEN flush THEN 0 ELSE marks END AS marks
    FROM (SELECT *, held > 0 AND joined > {_limit_sql('joined', '(cjk + c)', '(marks + m)')} AS flush
      FROM (SELECT sent.doc_id, sent.section_no, sent.i, n, c, m, done, held, cjk, marks, size + n + (held > 0)::BIGINT AS joined, {_limit_sql('n', 'c', 'm')} AS own
        FROM fold JOIN sent ON sent.doc_id = fold.doc_id AND sent.section_no = fold.section_no AND sent.i = fold.i + 1)))),
pieces AS (SELECT doc_id, section_no, first AS chunk, string_agg(t, ' ' ORDER BY i) AS text FROM fold JOIN sent USING (doc_id, section_no, i) WHERE NOT long GROUP BY ALL
  UNION ALL SELECT doc_id, section_no, first + k, substr(t, 1 + k * own, own) FROM fold JOIN sent USING (doc_id, section_no, i), unnest(range(0, done - first + 1)) AS r(k) WHERE long),
chunks AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, chunk) AS seq, section_no, section, pieces.text FROM pieces JOIN whole USING (doc_id, section_no))"""
PARENTS = f"""{CHILDREN}, parent AS (SELECT doc_id, seq, 1::BIGINT AS parent_no, section_no, length(text)::BIGINT + 2 AS held, length(text) AS n_chars FROM chunks WHERE seq = 1
UNION ALL SELECT doc_id, seq, parent_no + new::BIGINT, section_no, CASE WHEN new THEN 0 ELSE held END + n_chars + 2, n_chars
  FROM (SELECT c.doc_id, c.seq, p.parent_no, c.section_no, p.held, length(c.text) AS n_chars, c.section_no <> p.section_no OR p.held + length(c.text) + 2 > {B.PARENT_CHARS} AS new
    FROM parent p JOIN chunks c ON c.doc_id = p.doc_id AND c.seq = p.seq + 1))"""


def child_chunks(t: Tables) -> DataFrame:
    return B.children(sectioned(t), "doc_id", "ord")


@query("c14_children", f"WITH {CHILDREN} SELECT doc_id, seq::INTEGER AS seq, section_no::BIGINT AS section_no, section, text FROM chunks")
def c14(t: Tables) -> DataFrame:
    return child_chunks(t).select("doc_id", "seq", "section_no", "section", "text")


@query("c15_parents", f"WITH {PARENTS} SELECT doc_id, seq::INTEGER AS seq, parent_no, n_chars::INTEGER AS n_chars FROM parent")
def c15(t: Tables) -> DataFrame:
    return B.parents(child_chunks(t), "doc_id").select("doc_id", "seq", "parent_no", F.length("text").alias("n_chars"))


@query("c16_document_metadata", f"WITH {SECT} SELECT doc_id, ord, source, lang, n_chars FROM s JOIN documents USING (doc_id)")
def c16(t: Tables) -> DataFrame:
    return sectioned(t).select("doc_id", "ord").join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id", "left")


@query(
    "c17_chunk_report",
    f"""WITH {SECT} SELECT block_type, count(*)::BIGINT AS n, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most,
  list_sort(list(length(text)))[count(*) // 2 + 1]::BIGINT AS upper_median, round(avg(CASE WHEN regexp_matches(text, '[.!?。！？]$') THEN 0.0 ELSE 1.0 END), 6) AS open_share FROM s GROUP BY block_type""",
)
def c17(t: Tables) -> DataFrame:
    """The upper median comes from counts by length, so no list of all chunks is built."""
    sizes = sectioned(t).select("block_type", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text").rlike("[.!?。！？]$"), 0.0).otherwise(1.0).alias("open"))
    by_size = sizes.groupBy("block_type", "n_chars").agg(F.count("*").alias("c"), F.sum("open").alias("o"))
    so_far = F.sum("c").over(W.partitionBy("block_type").orderBy("n_chars"))
    total = F.sum("c").over(W.partitionBy("block_type"))
    by_size = by_size.withColumn("median", F.when(so_far > F.floor(total / 2), F.col("n_chars")))
    return by_size.groupBy("block_type").agg(
        F.sum("c").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.min("median").alias("upper_median"), F.round(F.sum("o") / F.sum("c"), 6).alias("open_share")
    )


@query(
    "c18_strip_table_html",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</t[dh]\s*>', '  ', 'g'), '(?i)</tr\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), ' *\n\s*', chr(10), 'g'), ' ')) AS text_md5 FROM pages""",
)
def c18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_table(F.col("html"))).alias("text_md5"))


@query(
    "c19_embed_text",
    f"""WITH e AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents)
SELECT doc_id, length(left(text, least(1000, {LIMIT})))::BIGINT AS n, md5(CASE WHEN trim(left(text, least(1000, {LIMIT}))) = '' THEN ' ' ELSE left(text, least(1000, {LIMIT})) END) AS text_md5 FROM e""",
)
def c19(t: Tables) -> DataFrame:
    e = t.documents.select("doc_id", B.embed_text(F.lit("text"), F.lit(None).cast("string"), F.col("text")).alias("e"))
    return e.select("doc_id", F.length("e").cast("long").alias("n"), F.md5("e").alias("text_md5"))


@query("c20_build_row", "SELECT doc_id::VARCHAR AS chunk_id, left(coalesce(source, ''), 4) AS title, left(coalesce(lang, ''), 2) AS block_type, coalesce(n_chars, 0)::INTEGER AS page, coalesce(length(source) > 4, false) AS cut FROM documents")
def c20(t: Tables) -> DataFrame:
    """A fixed schema: strings cut to their width, nulls as defaults, a mark where something was cut."""
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return t.documents.select(
        F.col("doc_id").cast("string").alias("chunk_id"), cut("source", 4).alias("title"), cut("lang", 2).alias("block_type"),
        F.coalesce("n_chars", F.lit(0)).cast("int").alias("page"), F.coalesce(F.length("source") > 4, F.lit(False)).alias("cut"),
    )


@query(
    "c21_enrich_figures",
    f"WITH {CAPTIONS} SELECT e.vec_id, CASE WHEN p.page_id IS NULL THEN 'figure ' || label::VARCHAR ELSE concat_ws(chr(10), c.caption, 'type: ' || label::VARCHAR, '1. ' || url) END AS text, label FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id LEFT JOIN c ON c.page_id = p.page_id",
)
def c21(t: Tables) -> DataFrame:
    """Figures (vectors) take the facts of their captions (pages of the same id) over: numbered claims below the summary. Those
    without facts keep their text, and all keep their other columns."""
    facts = captions(t).select(F.col("page_id").alias("vec_id"), "caption", F.array("url").alias("claims"))
    numbered = F.array_join(F.transform("claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    figures = t.embeddings.select("vec_id", F.concat(F.lit("figure "), F.col("label").cast("string")).alias("text"), "label")
    told = figures.join(facts, "vec_id").select("vec_id", F.concat_ws("\n", "caption", F.concat(F.lit("type: "), F.col("label").cast("string")), numbered).alias("text"), "label")
    return upsert(figures, told, "vec_id")


@query(
    "c22_caption_json",
    """WITH c AS (SELECT doc_id, lang, length(text) AS n, regexp_replace(left(text, 260), '[^a-z ]', '', 'g') AS claim FROM documents)
SELECT doc_id, CASE WHEN ok THEN lang END AS summary, CASE WHEN ok THEN array_to_string(list_transform(range(0, least(4, n % 7)), lambda i: i || left(claim, 199)), '|') END AS claims,
  CASE WHEN ok THEN CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END END AS confidence
FROM (SELECT *, coalesce(lang, '') <> '' AND doc_id % 11 > 0 AND doc_id % 13 > 0 AND n IS NOT NULL AS ok FROM c)""",
)
def c22(t: Tables) -> DataFrame:
    """Answers of a model: fenced or not, some cut off or without a list of claims, with too many and too long claims."""
    n, claim = F.length("text"), F.regexp_replace(F.left("text", F.lit(260)), "[^a-z ]", "")
    number = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n % 7)
    claims = F.to_json(F.transform(number, lambda i: F.concat(i.cast("string"), claim)))
    sure = F.when(n % 4 == 0, "high").when(n % 4 == 1, "low").otherwise("certain")
    json = F.concat(F.lit('{"summary": "'), F.coalesce("lang", F.lit("")), F.lit('", "key_claims": '), F.when(F.col("doc_id") % 11 == 0, F.lit('"none"')).otherwise(claims), F.lit(', "confidence": "'), sure, F.lit('"'))
    said = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("```json\n")).otherwise("Here it is: "), json, F.when(F.col("doc_id") % 13 == 0, F.lit(" and so on")).otherwise("}\n```"))
    rows = t.documents.select("doc_id", B.caption_facts(said).alias("f"))
    return rows.select("doc_id", F.col("f.summary").alias("summary"), F.array_join("f.claims", "|").alias("claims"), F.col("f.confidence").alias("confidence"))


@query(
    "c23_usable_chunks",
    f"""WITH {REFS} SELECT s.doc_id, ord FROM s JOIN r USING (doc_id, section_no) WHERE NOT is_reference AND length(text) >= 200 AND length(trim(s.section)) <= 40
  AND NOT regexp_matches(lower(trim(s.section)), '{"|".join(B.NOISE)}')""",
)
def c23(t: Tables) -> DataFrame:
    chunks = sectioned(t).join(reference_marked(t).select("doc_id", "section_no", "is_reference"), ["doc_id", "section_no"])
    return chunks.where(B.usable(F.col("section"), F.col("block_type"), F.col("text"), F.col("is_reference"))).select("doc_id", "ord")


@query(
    "c24_script_share",
    """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeiours', '中文字人口大小') WHEN doc_id % 3 = 1 THEN translate(text, 'ei', '中文') ELSE text END AS q FROM documents),
s AS (SELECT doc_id, CASE WHEN length(q) > 0 THEN (length(q) - length(regexp_replace(q, '[一-鿿]', '', 'g'))) / length(q) ELSE 0 END AS s FROM q)
SELECT doc_id, round(s, 6) AS share, s > 0.3 AS question_class, s >= 0.15 AS text_class FROM s""",
)
def c24(t: Tables) -> DataFrame:
    """The share of CJK characters and its two classes, whose limits differ on purpose. Two thirds of the texts have letters turned into CJK ones."""
    d = F.col("doc_id") % 3
    text = F.when(d == 0, F.translate("text", "aeiours", "中文字人口大小")).when(d == 1, F.translate("text", "ei", "中文")).otherwise(F.col("text"))
    share = X.cjk_share(text)
    return t.documents.select("doc_id", F.round(share, 6).alias("share"), (share > 0.3).alias("question_class"), (share >= 0.15).alias("text_class"))


@query("c25_longest_caption", f"WITH {CAPTIONS} SELECT regexp_extract(url, '://([^/]+)', 1) AS host, c.page_id, length(caption)::BIGINT AS n FROM c JOIN pages USING (page_id) QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(caption) DESC, c.page_id) = 1")
def c25(t: Tables) -> DataFrame:
    """One block for each image (host here): the one with the longest caption."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    best = captions(t).groupBy(host.alias("host")).agg(F.max(F.struct(F.length("caption").cast("long").alias("n"), (-F.col("page_id")).alias("p"))).alias("b"))
    return best.select("host", (-F.col("b.p")).alias("page_id"), F.col("b.n").alias("n"))
