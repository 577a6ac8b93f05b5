"""Catalog queries: parts, suppliers and documents stand for the items, files and notes of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import catalog as K
from quarry.plans.base import Tables, query


@query(
    "k1_split_notes",
    """WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND NOT (conv_id % 2 = 0 AND n > 1) THEN lpad((turn + 1)::VARCHAR, greatest(3, length((turn + 1)::VARCHAR))::INTEGER, '0') ELSE lpad(place::VARCHAR, greatest(3, length(place::VARCHAR))::INTEGER, '0') END AS item_id,
  role AS title, trim('> ' || regexp_replace(text, '\\s', ' ', 'g')) AS body FROM n""",
)
def k1(t: Tables) -> DataFrame:
    """Notes with numbered headings, with numbers that repeat, and without numbers become one row for each item."""
    body = F.concat(F.lit("\n\n> "), F.regexp_replace("text", "\\s", " "))
    number = F.when(F.col("conv_id") % 2 == 0, F.lit("1")).otherwise((F.col("turn") + 1).cast("string"))
    heading = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("## **"), number, F.lit("\\. "), "role", F.lit("**"))).otherwise(F.concat(F.lit("### "), "role"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(heading, body).alias("part")))), lambda x: x["part"])
    notes = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("# 目录\nno item\n"), F.array_join(parts, "\n")).alias("notes"))
    return K.split_items(notes, "conv_id", "notes")


@query(
    "k2_extract_fields",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN source END AS reader, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.1234/' || doc_id WHEN 1 THEN 'https://doi.org/10.98765/x.' || doc_id END AS link,
  array_to_string(list_filter(['license', 'public', 'work', 'outre', 'nicht', 'en'], lambda k: contains(coalesce(lang, '') || chr(10) || left(b, 500), k)), ';') AS keywords
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN '阅读整理者：' || source || chr(10) WHEN 1 THEN '阅读者: ' || source || chr(10) WHEN 2 THEN '分享人：' || source || chr(10) ELSE '' END
  || CASE doc_id % 3 WHEN 0 THEN '(https://doi.org/10.1234/' || doc_id || ') ' WHEN 1 THEN 'see 10.98765/x.' || doc_id || chr(10) ELSE '' END || regexp_replace(coalesce(text, ''), '[0-9：:]', '', 'g') AS b FROM documents)""",
)
def k2(t: Tables) -> DataFrame:
    """Reader, link and keywords from the bodies of notes, which are documents with a line in one of the forms before them."""
    doc = F.col("doc_id")
    line = F.when(doc % 4 == 0, F.concat(F.lit("阅读整理者："), "source", F.lit("\n"))).when(doc % 4 == 1, F.concat(F.lit("阅读者: "), "source", F.lit("\n"))).when(doc % 4 == 2, F.concat(F.lit("分享人："), "source", F.lit("\n"))).otherwise("")
    link = F.when(doc % 3 == 0, F.concat(F.lit("(https://doi.org/10.1234/"), doc.cast("string"), F.lit(") "))).when(doc % 3 == 1, F.concat(F.lit("see 10.98765/x."), doc.cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(line, link, F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9：:]", ""))
    rows = t.documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("title"), body.alias("b"))
    words = ["license", "public", "work", "outre", "nicht", "en"]
    return rows.select("doc_id", K.reader(F.col("b")).alias("reader"), K.doi(F.col("b")).alias("link"), K.keywords(F.col("title"), F.col("b"), words).alias("keywords"))


@query(
    "k3_attachments",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'talk_' || page_id || '.pptx|' || page_id || ' notes.pdf|paper-' || page_id || '.PDF' ELSE page_id || ' notes.pdf|paper-' || page_id || '.PDF' END AS names FROM pages""",
)
def k3(t: Tables) -> DataFrame:
    """Attached files named in links, with escapes, and in plain text, some of them twice."""
    n = F.col("page_id").cast("string")
    linked = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("[talk\\_"), n, F.lit("\\.pptx]("), "url", F.lit(")\n- talk\\_"), n, F.lit(".pptx\n"))).otherwise("")
    body = F.concat(linked, F.lit("* "), n, F.lit("%20notes.pdf\n("), F.lit("paper-"), n, F.lit(".PDF)\n"), n, F.lit(" notes.pdf\nno file"))
    return t.pages.select("page_id", F.array_join(K.attachments(body, (".ppt", ".pptx", ".pdf")), "|").alias("names"))


FOLD = r"regexp_replace(lower(coalesce({0}, '')), '[\s.,;:()\[\]{{}}<>\"''`!?/\\|~@#$%^&*+=_-]+', '', 'g')"


@query("k4_match_files")
def k4(t: Tables) -> DataFrame:
    """Parts look for their files, whose names lost every fifth character."""
    short = F.array_join(F.filter(F.split(F.lower("p_name"), ""), lambda c, i: i % 5 != 4), "")
    return K.match(t.part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name")), t.part.select(F.col("p_partkey").alias("file"), short.alias("file_name")))


@query(
    "k5_status",
    "SELECT p_partkey, CASE WHEN s AND o THEN 'ready' WHEN s THEN 'missing_ppt' WHEN o THEN 'missing_pdf' ELSE 'note_only' END AS status FROM (SELECT p_partkey, p_size > 25 AS s, p_retailprice > 1000 AS o FROM part)",
)
def k5(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", K.status(F.col("p_size") > 25, F.col("p_retailprice") > 1000).alias("status"))


@query(
    "k6_override",
    """WITH o AS (SELECT s_suppkey AS p_partkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS p_name, '' AS p_brand FROM supplier)
SELECT p.p_partkey, coalesce(nullif(o.p_name, ''), p.p_name) AS p_name, coalesce(nullif(o.p_brand, ''), p.p_brand) AS p_brand, coalesce(o.p_name <> '', false) AS changed FROM part p LEFT JOIN o USING (p_partkey)""",
)
def k6(t: Tables) -> DataFrame:
    by = t.supplier.select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("").alias("p_name"), F.lit("").alias("p_brand"))
    return K.override(t.part.select("p_partkey", "p_name", "p_brand"), by, "p_partkey", ["p_name", "p_brand"])


@query(
    "k7_fill_by_order",
    """WITH c AS (SELECT c_custkey, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT g, c_custkey, s_suppkey FROM c LEFT JOIN s USING (g, i)""",
)
def k7(t: Tables) -> DataFrame:
    left = t.customer.select(F.col("c_nationkey").alias("g"), "c_custkey")
    return K.fill_by_order(left, t.supplier.select(F.col("s_nationkey").alias("g"), "s_suppkey"), "g", "c_custkey", "s_suppkey")


@query(
    "k8_lookup",
    """WITH c AS (SELECT CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS item_id, p_brand AS reader,
  CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 'ready' WHEN p_size > 25 THEN 'missing_ppt' WHEN p_retailprice > 1000 THEN 'missing_pdf' ELSE 'note_only' END AS status FROM part)
SELECT 'reader' AS way, item_id, status FROM c WHERE contains(reader, '#1') UNION ALL SELECT 'status', item_id, status FROM c WHERE status = 'missing_pdf'
UNION ALL SELECT 'id', item_id, status FROM c WHERE item_id = '007' UNION ALL SELECT 'missing', item_id, status FROM c WHERE status <> 'ready'""",
)
def k8(t: Tables) -> DataFrame:
    """The catalog by reader, by a user's word for a status, by id, and its items with missing files."""
    rows = t.part.select(K.item_id(F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_brand").alias("reader"), K.status(F.col("p_size") > 25, F.col("p_retailprice") > 1000).alias("status"))
    ways = {"reader": {"reader": " #1"}, "status": {"status": "缺PDF "}, "id": {"item": "7"}, "missing": {"missing": True}}
    out = None
    for way, how in ways.items():
        part = K.lookup(rows, **how).select(F.lit(way).alias("way"), "item_id", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "k9_library_search",
    """WITH h AS (SELECT p_partkey, p_name, p_partkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS favourite FROM part
  WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR)), 'brand#1'))
SELECT p_partkey, p_name, favourite, count(*) OVER () AS total FROM h ORDER BY p_partkey LIMIT 300""",
)
def k9(t: Tables) -> DataFrame:
    """The first 300 hits and the number of all: the page size is the feature."""
    liked = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("p_partkey")).distinct().withColumn("favourite", F.lit(True))
    hits = t.part.where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))), F.lit("brand#1")))
    total = hits.agg(F.count("*").alias("total"))  # one row
    first = hits.join(liked, "p_partkey", "left").orderBy("p_partkey").limit(300)
    return first.crossJoin(F.broadcast(total)).select("p_partkey", "p_name", F.coalesce("favourite", F.lit(False)).alias("favourite"), "total")


@query("k10_first_row", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def k10(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_semi").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query(
    "k11_next_id",
    """WITH a AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR END AS explicit, 'file-' || (s_suppkey * 2) AS file FROM supplier),
c AS (SELECT p_partkey AS n, 'file-' || p_partkey AS file FROM part WHERE p_partkey % 4 = 0)
SELECT key, CASE WHEN explicit IS NOT NULL THEN lpad(explicit, greatest(3, length(explicit))::INTEGER, '0') WHEN c.n IS NOT NULL THEN lpad(c.n::VARCHAR, greatest(3, length(c.n::VARCHAR))::INTEGER, '0')
  ELSE (SELECT lpad((max(n) + 1)::VARCHAR, greatest(3, length((max(n) + 1)::VARCHAR))::INTEGER, '0') FROM c) END AS item_id FROM a LEFT JOIN c USING (file)""",
)
def k11(t: Tables) -> DataFrame:
    """Suppliers ask for ids of a catalog of parts: a third by number, others by their file, the rest take the next free one."""
    file = lambda c: F.concat(F.lit("file-"), c.cast("string"))
    key = F.col("s_suppkey")
    asked = t.supplier.select(key.alias("key"), F.when(key % 3 == 0, key.cast("string")).alias("explicit"), file(key * 2).alias("file"))
    catalog = t.part.where("p_partkey % 4 = 0").select(K.item_id(F.col("p_partkey").cast("string")).alias("item_id"), file(F.col("p_partkey")).alias("file"))
    return K.resolve_ids(asked, catalog)


@query("k12_title_map", "SELECT source, min_by(title, doc_id) AS title, count(DISTINCT title)::BIGINT AS titles FROM (SELECT source, doc_id, string_split(text, chr(10))[1] AS title FROM documents) WHERE length(title) >= 8 GROUP BY source")
def k12(t: Tables) -> DataFrame:
    titles = t.documents.select("source", "doc_id", X.first_line(F.col("text")).alias("title")).where("length(title) >= 8")
    return titles.groupBy("source").agg(F.min_by("title", "doc_id").alias("title"), F.countDistinct("title").alias("titles"))


@query("k13_source_lookup", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN source ELSE '' END, ''), url, 'unknown') AS source_url FROM documents LEFT JOIN pages ON page_id = doc_id")
def k13(t: Tables) -> DataFrame:
    """A source that a chunk names itself wins over the one in the table of sources (pages)."""
    own = F.nullif(F.when(F.col("lang") == "en", F.col("source")).otherwise(""), F.lit(""))
    joined = t.documents.join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(own, "url", F.lit("unknown")).alias("source_url"))
