"""Retrieval queries. Passages of `benchmark` ask `documents`; vectors whose id is divisible by 100 ask `embeddings`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import contain as C
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.plans.base import Tables, anchored_sql, query, shared
from quarry.plans.scans import scratch
from quarry.plans.streams import in_order
from quarry.sources.shared import stored
from quarry.streaming import state as S

K = 10

# Common table expressions of the SQL side.
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
BM25_CTE = f"""
d AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents),
p AS (SELECT doc_id, t AS term, count(*) AS tf FROM d, unnest(w) AS u(t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
n AS (SELECT (SELECT count(doc_id) FROM documents) AS n, (SELECT sum(tf) FROM p) / (SELECT count(doc_id) FROM documents) AS avgdl),
q AS (SELECT item_id, t AS term, count(*) AS qtf FROM benchmark, unnest({TOK.format('text')}) AS u(t) GROUP BY ALL),
sc AS (
  SELECT q.item_id AS query_id, p.doc_id AS key,
    round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term) JOIN dl USING (doc_id), n GROUP BY ALL HAVING score > 0),
bm AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc QUALIFY rank <= 20)"""
COS = "round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6)"
DENSE_CTE = f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, v.vec_id AS key, {COS} AS score FROM v q, v WHERE q.vec_id % 100 = 0),
de AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM ds QUALIFY rank <= 20)"""


def forward(t: Tables) -> I.Forward:
    """The index of `documents`, shared by the queries of a session."""
    return shared(t, "forward", ["documents"], lambda: I.build(t.documents, "doc_id", F.col("text")))


def bm25(t: Tables, k: int = 20, keep: DataFrame | None = None) -> DataFrame:
    return I.bm25(t.benchmark, forward(t), query_key="item_id", query_text="text", k=k, keep=keep)


def dense(t: Tables, k: int = 20) -> DataFrame:
    asked = t.embeddings.where("vec_id % 100 = 0")
    return I.cosine_top(asked, t.embeddings, query_key="vec_id", query_vector="embedding", key="vec_id", vector="embedding", k=k)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@query("r1_tokenize", f"SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS tokens FROM documents")
def r1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(
    "r2_field_weighted_tf",
    f"""SELECT key, term, sum(tf)::BIGINT AS tf FROM (
  SELECT doc_id AS key, unnest({TOK.format('source')}) AS term, 3 AS tf FROM documents
  UNION ALL SELECT doc_id, unnest({TOK.format('doc_id::VARCHAR')}), 2 FROM documents
  UNION ALL SELECT doc_id, unnest({TOK.format('lang')}), 3 FROM documents
  UNION ALL SELECT doc_id, unnest({TOK.format('text')}), 1 FROM documents) GROUP BY ALL""",
)
def r2(t: Tables) -> DataFrame:
    """Fields count by weight: the source as title 3, the id 2, the language as reader 3, the text 1."""
    return I.weighted_terms(t.documents, "doc_id", {"source": 3, "doc_id": 2, "lang": 3, "text": 1})


@query("r3_postings", f"WITH {BM25_CTE} SELECT p.doc_id AS key, p.term, p.tf::BIGINT AS tf, df.df::BIGINT AS df, dl.dl::BIGINT AS dl FROM p JOIN df USING (term) JOIN dl USING (doc_id)")
def r3(t: Tables) -> DataFrame:
    index = forward(t)
    post = index.rows.select("key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return post.select("key", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).join(index.df, "term").select("key", "term", "tf", "df", "dl")


@query("r4_bm25_topk", f"WITH {BM25_CTE} SELECT query_id, key, score, rank FROM bm WHERE rank <= {K}")
def r4(t: Tables) -> DataFrame:
    return ranked(bm25(t, K))


@query(
    "r4_bm25_filtered",
    f"WITH {BM25_CTE} SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc JOIN documents ON doc_id = key WHERE lang = 'en' QUALIFY rank <= {K}",
)
def r4_filtered(t: Tables) -> DataFrame:
    """A filter on the documents leaves the corpus statistics as they are."""
    return ranked(bm25(t, K, t.documents.where("lang = 'en'").select(F.col("doc_id").alias("key"))))


@query("r5_dense_topk", f"WITH {DENSE_CTE} SELECT query_id, key, score, rank FROM de WHERE rank <= {K}")
def r5(t: Tables) -> DataFrame:
    return ranked(dense(t, K))


@query("r5_dense_lsh")
def r5_lsh(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 100 = 0")
    return ranked(R.dense_lsh(asked, t.embeddings, key="vec_id", vector="embedding", width=64, k=K))


@query("r6_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1' AND text NOT LIKE '%References%'")
def r6(t: Tables) -> DataFrame:
    """Conditions are columns joined by and; values need no escaping."""
    wanted = [F.col("lang") == "en", F.col("source") == "src1", ~F.contains(F.col("text"), F.lit("References"))]
    condition = wanted[0]
    for more in wanted[1:]:
        condition = condition & more
    return t.documents.where(condition).select("doc_id", "lang", "source")


HYBRID_CTE = f"""{BM25_CTE},{DENSE_CTE},
hy AS (SELECT query_id, key, rank FROM bm WHERE query_id % 100 = 0 UNION ALL SELECT query_id, key, rank FROM de),
fu AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM hy GROUP BY ALL)"""


def hybrid(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The two branches of the queries that both have: passage and vector of the same id."""
    return bm25(t).where("query_id % 100 = 0"), dense(t)


@query("r7_rrf", f"WITH {HYBRID_CTE} SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM fu QUALIFY rank <= {K}")
def r7(t: Tables) -> DataFrame:
    return ranked(R.fuse(list(hybrid(t)), K))


KEYED_CTE = f"""{HYBRID_CTE},
bs AS (SELECT query_id, source AS key, rank FROM bm JOIN documents ON doc_id = bm.key WHERE query_id % 100 = 0),
dd AS (SELECT query_id, source AS key, rank FROM de JOIN documents ON doc_id = de.key)"""


def _keyed(sparse: str, dense_: str) -> str:
    return f"""WITH {KEYED_CTE},
a AS (SELECT query_id, key, {sparse}(rank) AS bm25_rank FROM bs GROUP BY ALL),
b AS (SELECT query_id, key, {dense_}(1.0::DOUBLE / (60 + rank)) AS part, min(rank) AS dense_rank FROM dd GROUP BY ALL)
SELECT query_id, key, bm25_rank, dense_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(part, 0), 9) AS score FROM a FULL JOIN b USING (query_id, key)"""


def _by_source(t: Tables, last_wins: bool) -> DataFrame:
    sparse, dense_ = hybrid(t)
    source = t.documents.select(F.col("doc_id").alias("key"), "source")
    coarse = lambda df: df.join(source, "key").select("query_id", F.col("source").alias("key"), F.col("rank").cast("long").alias("rank"))
    return R.fuse_keyed(coarse(sparse), coarse(dense_), last_wins=last_wins)


@query("r8_fuse_by_source", _keyed("min", "max"))
def r8(t: Tables) -> DataFrame:
    return _by_source(t, False)


@query("r8_fuse_by_source_last", _keyed("max", "sum"))
def r8_last(t: Tables) -> DataFrame:
    return _by_source(t, True)


@query(
    "r9_branch_queries",
    """WITH t AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE left(text, 60) END AS told FROM documents WHERE doc_id % 2 = 0)
SELECT item_id, text AS dense_text, s AS sparse_text, CASE WHEN s IS NULL THEN 'dense' ELSE 'hybrid' END AS branches
FROM (SELECT b.item_id, b.text, coalesce(nullif(trim(told), ''), CASE WHEN length(b.text) % 3 = 0 THEN nullif(trim(b.text), '') END) AS s FROM benchmark b LEFT JOIN t ON t.item_id = b.item_id)""",
)
def r9(t: Tables) -> DataFrame:
    """Passages as queries; the table of translations (documents of even ids here) has some, and some that are blank."""
    told = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.left("text", F.lit(60))).alias("translation"))
    queries = t.benchmark.select("item_id", "text", (F.length("text") % 3 == 0).alias("own"))
    return R.branch_queries(queries, told, "item_id", "text")


VARIANTS = ("dense", "dense_sparse", "concatenated", "three_way")


@query(
    "r10_variant_recall",
    f"""WITH told AS (SELECT doc_id, nullif(trim(CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE left(text, 60) END), '') AS told FROM documents WHERE doc_id % 2 = 0),
asked AS (SELECT item_id * 4 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 4 + 1, told FROM benchmark JOIN told ON doc_id = item_id WHERE told IS NOT NULL
  UNION ALL SELECT item_id * 4 + 2, concat_ws(' ', text, told) FROM benchmark LEFT JOIN told ON doc_id = item_id),
{BM25_CTE.replace('FROM benchmark', 'FROM asked')},{DENSE_CTE.replace('q.vec_id % 100 = 0', 'q.vec_id IN (SELECT item_id FROM benchmark)')},
br AS (SELECT v, query_id, key, rank FROM de, (VALUES ('dense'), ('dense_sparse'), ('concatenated'), ('three_way')) AS t(v)
  UNION ALL SELECT 'dense_sparse', query_id // 4, key, rank FROM bm WHERE query_id % 4 = 1 UNION ALL SELECT 'concatenated', query_id // 4, key, rank FROM bm WHERE query_id % 4 = 2
  UNION ALL SELECT 'three_way', query_id // 4, key, rank FROM bm WHERE query_id % 4 < 2),
fu AS (SELECT v, query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM br GROUP BY ALL),
fr AS (SELECT v, query_id, key FROM fu QUALIFY row_number() OVER (PARTITION BY v, query_id ORDER BY score DESC, key) <= {K}),
x AS (SELECT item_id AS query_id, doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
c AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id),
r AS (SELECT t.v, c.query_id, c.n, count(fr.key) / c.n AS recall FROM c CROSS JOIN (VALUES ('dense'), ('dense_sparse'), ('concatenated'), ('three_way')) AS t(v) JOIN x ON x.query_id = c.query_id
  LEFT JOIN fr ON fr.v = t.v AND fr.query_id = x.query_id AND fr.key = x.key GROUP BY t.v, c.query_id, c.n)
SELECT v AS variant, CASE WHEN n = 1 THEN 'one' ELSE 'many' END AS category, count(*)::BIGINT AS cases, round(avg(recall), 6) AS recall FROM r GROUP BY ALL""",
)
def r10(t: Tables) -> DataFrame:
    """Mean set recall of four ways to ask: the vector alone; with the translation's words; with passage and translation as one text of
    words; with both of them as branches of their own. Cases that expect nothing take no part; the others are told apart by whether
    they expect one document or many."""
    told = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.left("text", F.lit(60))).alias("told"))
    both = t.benchmark.join(told.withColumn("told", F.nullif(F.trim("told"), F.lit(""))), "item_id", "left")
    texts = F.array(F.col("text"), F.col("told"), F.concat_ws(" ", "text", "told"))
    asked = both.select("item_id", F.posexplode(texts).alias("kind", "text")).where("text is not null").withColumn("asked", F.col("item_id") * 4 + F.col("kind"))
    hits = stored(I.bm25(asked, forward(t), query_key="asked", query_text="text", k=20), "r10")
    branch = lambda kind: hits.where(F.col("query_id") % 4 == kind).withColumn("query_id", F.expr("query_id div 4"))
    vectors = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense_ = stored(I.cosine_top(vectors, t.embeddings, query_key="vec_id", query_vector="embedding", key="vec_id", vector="embedding", k=20), "r10")
    ways = dict(zip(VARIANTS, ([dense_], [dense_, branch(1)], [dense_, branch(2)], [dense_, branch(1), branch(0)])))
    found = reduce(DataFrame.unionByName, [R.fuse(parts, K).select(F.lit(name).alias("variant"), "query_id", "key", F.lit(1).alias("hit")) for name, parts in ways.items()])
    expected = expected_hits(t).select("query_id", "key", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    cases = expected.join(found, ["variant", "query_id", "key"], "left").groupBy("variant", "query_id").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))
    return cases.groupBy("variant", F.when(F.col("n") == 1, "one").otherwise("many").alias("category")).agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"))


def expected_hits(t: Tables) -> DataFrame:
    """query_id, key, lang: documents that hold the passage."""
    held = lambda: C.contained(t.documents, t.benchmark, key="doc_id", text="text", passage_key="item_id", passage="text")
    hits = shared(t, "expected", ["documents", "benchmark"], held)
    langs = t.documents.select(F.col("doc_id").alias("key"), "lang")
    return hits.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("key")).join(langs, "key")


RERANK_CTE = f"""{BM25_CTE},
pr AS (SELECT bm.query_id, bm.key, bm.rank, list_distinct({TOK.format('b.text')}) AS a, list_distinct({TOK.format('d.text')}) AS c
  FROM bm JOIN benchmark b ON b.item_id = bm.query_id JOIN documents d ON d.doc_id = bm.key),
rr AS (SELECT query_id, key, rank, round(CASE WHEN len(list_intersect(a, c)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) ELSE 0 END, 6) AS rerank_score FROM pr)"""

#: The verdict's contract takes the beginning of a text.
VERDICT_CTE, VERDICT_CHARS = RERANK_CTE.replace(TOK.format("d.text"), TOK.format("left(d.text, 1200)")), 1200


def reranked(t: Tables, chars: int | None = None) -> DataFrame:
    """The hits of the passages with their F1 to the whole text, or to its first `chars` characters. Hits are written first: they are
    few rows then for Spark, and the texts of all documents need no shuffle."""
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    docs = t.documents.select(F.col("doc_id").alias("key"), text.alias("text"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    pairs = stored(bm25(t), "rerank").join(docs, "key").join(asked, "query_id")
    return pairs.select("query_id", "key", F.col("rank").cast("long").alias("rank"), R.overlap_f1(F.col("passage"), F.col("text")).alias("rerank_score"))


@query("r11_rerank", f"WITH {RERANK_CTE} SELECT query_id, key, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rr")
def r11(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return reranked(t).select("query_id", "key", "rerank_score", F.row_number().over(w).cast("long").alias("new_rank"))


@query(
    "r12_verdict",
    f"""WITH {VERDICT_CTE}, m AS (SELECT query_id, max(rerank_score) AS top_score, count(*) AS n FROM rr GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0)::BIGINT AS n, top_score, CASE WHEN n IS NULL THEN false ELSE top_score >= 0.3 END AS confident,
  CASE WHEN n IS NULL THEN 'empty' WHEN top_score >= 0.3 THEN 'ok' ELSE 'below_gate' END AS reason FROM benchmark LEFT JOIN m ON item_id = query_id""",
)
def r12(t: Tables) -> DataFrame:
    return R.verdict(t.benchmark.select(F.col("item_id").alias("query_id")), reranked(t, VERDICT_CHARS), F.lit(0.3))


@query(
    "r13_gate_by_intent",
    "SELECT event_type AS intent, CASE WHEN event_type IN ('view', 'click') THEN 0.35 ELSE 0.8 END::DOUBLE AS gate, count(*)::BIGINT AS n, "
    "count(*) FILTER (value / 100 >= CASE WHEN event_type IN ('view', 'click') THEN 0.35 ELSE 0.8 END)::BIGINT AS passed FROM events GROUP BY ALL",
)
def r13(t: Tables) -> DataFrame:
    """Summaries (views and clicks here) have a lower gate than the rest; the gates are a small table of their own."""
    gates = t.spark.createDataFrame([("view", 0.35), ("click", 0.35)], "intent string, gate double")  # a fixed table
    logs = t.events.select(F.col("event_type").alias("intent"), (F.col("value") / 100).alias("score")).join(F.broadcast(gates), "intent", "left")
    logs = logs.withColumn("gate", F.coalesce("gate", F.lit(0.8)))
    return logs.groupBy("intent", "gate").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("gate")).alias("passed"))


@query(
    "r14_item_override",
    f"""WITH {RERANK_CTE}, x AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
h AS (SELECT query_id, rerank_score FROM rr JOIN documents ON doc_id = key WHERE source IS DISTINCT FROM 'src1' OR query_id % 3 < 2),
m AS (SELECT query_id, count(*) AS hits, max(rerank_score) AS top_score FROM h GROUP BY query_id)
SELECT m.query_id, hits, CASE WHEN m.query_id % 5 > 0 THEN top_score >= 0.3 END AS confident, (x.item_id IS NOT NULL) AS item_filter,
  CASE WHEN m.query_id % 5 > 0 THEN (top_score >= 0.3 OR x.item_id IS NOT NULL) END AS final_confident
FROM m LEFT JOIN x ON x.item_id = m.query_id""",
)
def r14(t: Tables) -> DataFrame:
    """A question about one known item is answered from it even below the gate. Intents go by id here (none, metadata, others), one
    source stands for reference sections, and every fifth query was not reranked."""
    known = expected_hits(t).select("query_id").distinct().withColumn("item_filter", F.lit(True))
    intent = F.element_at(F.array(*map(F.lit, ("", "metadata_query", "summary_paper"))), (F.col("query_id") % 3 + 1).cast("int"))
    sources = t.documents.select(F.col("doc_id").alias("key"), F.coalesce(F.col("source") == "src1", F.lit(False)).alias("is_reference"))
    hits = reranked(t).join(sources, "key").where(~F.col("is_reference") | R.keeps_references(intent))
    was = F.col("query_id") % 5 > 0
    best = hits.groupBy("query_id").agg(F.count("*").alias("hits"), (F.max("rerank_score") >= 0.3).alias("confident")).withColumn("confident", F.when(was, F.col("confident")))
    out = best.join(known, "query_id", "left").withColumn("item_filter", F.coalesce("item_filter", F.lit(False)))
    return out.withColumn("final_confident", R.scoped_confidence(F.col("confident"), was, F.col("item_filter"), F.col("hits")))


@query(
    "r15_interleave",
    f"""WITH {HYBRID_CTE}, bo AS (SELECT query_id, key, rank, 0 AS branch FROM bm WHERE query_id % 100 = 0 UNION ALL SELECT query_id, key, rank, 1 FROM de),
pl AS (SELECT query_id, key, min(rank * 2 + branch) AS place FROM bo GROUP BY ALL)
SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY place, key) AS rank FROM pl QUALIFY rank <= {K}""",
)
def r15(t: Tables) -> DataFrame:
    return R.interleave(*hybrid(t), K).select("query_id", "key", F.col("rank").cast("long").alias("rank"))


CHUNK_CTE = """
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id AS parent_id, text AS parent_text, i, doc_id::VARCHAR || '_c' || i::VARCHAR AS chunk_id, ls[i] AS chunk FROM l, unnest(range(1, len(ls) + 1)) AS r(i) WHERE length(ls[i]) > 0)"""


def line_chunks(t: Tables) -> DataFrame:
    """Every non-empty line of a document as a child chunk of it."""
    lines = t.documents.where("text is not null").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"), F.posexplode(F.split("text", "\n")).alias("p", "chunk"))
    lines = lines.where("length(chunk) > 0").withColumn("i", (F.col("p") + 1).cast("long"))
    return lines.withColumn("chunk_id", F.concat(F.col("parent_id").cast("string"), F.lit("_c"), F.col("i").cast("string")))


WINDOW_SQL = """CASE WHEN length(parent_text) <= 1200 THEN parent_text ELSE
  (CASE WHEN st > 0 THEN '……' ELSE '' END) || substr(parent_text, st + 1, 1200) || (CASE WHEN st + 1200 < length(parent_text) THEN '……' ELSE '' END) END"""


@query(
    "r16_context_window",
    f"""WITH {CHUNK_CTE}, s AS (SELECT *, CASE WHEN strpos(parent_text, left(chunk, 100)) = 0 THEN 0 ELSE greatest(0, strpos(parent_text, left(chunk, 100)) - 1 - 500) END AS st FROM c)
SELECT chunk_id, md5({WINDOW_SQL}) AS context_md5 FROM s""",
)
def r16(t: Tables) -> DataFrame:
    chunks = line_chunks(t)
    return chunks.select("chunk_id", F.md5(R.window_of(chunks, "chunk", "parent_text")).alias("context_md5"))


@query(
    "r17_small_to_big",
    f"""WITH {CHUNK_CTE}, h AS (SELECT b.item_id AS query_id, c.*, row_number() OVER (PARTITION BY b.item_id ORDER BY length(chunk) DESC, chunk_id) AS rank
  FROM benchmark b JOIN c ON contains(b.text, chunk) WHERE length(chunk) >= 20),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1),
s AS (SELECT *, CASE WHEN strpos(parent_text, left(chunk, 100)) = 0 THEN 0 ELSE greatest(0, strpos(parent_text, left(chunk, 100)) - 1 - 500) END AS st FROM k)
SELECT query_id, chunk_id AS key, rank, md5({WINDOW_SQL}) AS context_md5 FROM s WHERE rank <= 50""",
)
def r17(t: Tables) -> DataFrame:
    chunks = line_chunks(t)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hits = C.parts_of(chunks.select("chunk_id", "parent_id", "chunk"), asked, piece="chunk", text="passage", least=20)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("chunk")), "chunk_id")
    hits = hits.select("query_id", F.col("chunk_id").alias("key"), F.row_number().over(order).cast("long").alias("rank"), F.col("parent_id").cast("string").alias("parent_id"), F.col("chunk").alias("text"))
    parents = t.documents.select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("parent_text"))
    return R.small_to_big(hits, parents, 50).select("query_id", "key", "rank", F.md5("context").alias("context_md5"))


@query("r18_siblings", f"WITH {CHUNK_CTE} SELECT parent_id, chunk_id, row_number() OVER (PARTITION BY parent_id ORDER BY i, chunk_id) AS pos FROM c QUALIFY pos <= 50")
def r18(t: Tables) -> DataFrame:
    """At most 50 siblings of a parent in reading order: the limit is the feature."""
    return R.top(line_chunks(t), ["parent_id"], ["i", "chunk_id"], 50, "pos").select("parent_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query(
    "r19_group_hits",
    f"WITH {DENSE_CTE} SELECT query_id, source AS item, max(score) AS best, count(*)::BIGINT AS hits, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM de JOIN documents ON doc_id = key GROUP BY ALL",
)
def r19(t: Tables) -> DataFrame:
    hits = dense(t).join(t.documents.select(F.col("doc_id").alias("key"), "source", "lang"), "key")
    types = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    return hits.groupBy("query_id", F.col("source").alias("item")).agg(F.max("score").alias("best"), F.count("*").alias("hits"), types.alias("types"))


CITED_SQL = f"""WITH u AS (SELECT conv_id AS thread, turn, list_distinct({TOK.format('text')}) AS w FROM conversations),
x AS (SELECT thread, turn, s AS source FROM u, unnest(w) AS r(s) WHERE length(s) >= 6),
f AS (SELECT thread, source, min(turn) AS first FROM x GROUP BY ALL)
SELECT thread, source, first, row_number() OVER (PARTITION BY thread ORDER BY first, source) AS number FROM f"""


def source_uses(turns: DataFrame) -> DataFrame:
    """Long words of a turn stand for its sources."""
    uses = turns.select(F.col("conv_id").alias("thread"), F.col("turn").alias("ord"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("source"))
    return uses.where("length(source) >= 6")


@query("r20_citation_numbers", CITED_SQL)
def r20(t: Tables) -> DataFrame:
    """Numbers go on from turn to turn."""
    return R.citation_numbers(source_uses(t.conversations)).withColumn("number", F.col("number").cast("long"))


@query("r20_citation_stream", CITED_SQL)
def r20_stream(t: Tables) -> DataFrame:
    """The same numbers from a stream that is stopped after the first turns of all threads and goes on with the others."""
    inbox, out, state = scratch(t, "r20-turns"), scratch(t, "r20-numbers"), scratch(t, "r20-state")
    turns = t.conversations.select("conv_id", "turn", "text")
    for part in ("turn < 3", "turn >= 3 or turn is null"):
        turns.where(part).write.mode("append").parquet(inbox)
        uses = source_uses(t.spark.readStream.schema(turns.schema).parquet(inbox))
        numbers = S.run_with_state(S.citation_numbers(uses), out, state)
    return numbers


@query(
    "r21_source_blocks",
    f"""WITH {DENSE_CTE} SELECT query_id, CASE WHEN de.rank % 2 = 1 THEN de.rank END AS n, CASE WHEN de.rank % 2 = 0 THEN de.key::VARCHAR ELSE '' END AS item_id,
  'title of ' || source AS title, CASE WHEN de.rank % 2 = 1 THEN source ELSE '' END AS source_file, 'p. ' || de.rank::VARCHAR AS location FROM de JOIN documents ON doc_id = de.key""",
)
def r21(t: Tables) -> DataFrame:
    """The 20 hits of a query as one tool text in the two forms of the corpus, taken apart again."""
    hits = dense(t).join(t.documents.select(F.col("doc_id").alias("key"), "source"), "key")
    number, key = F.col("rank").cast("string"), F.col("key").cast("string")
    listed = F.concat(number, F.lit(". 文献编号："), key)
    chunk = F.concat(F.lit("资料"), number, F.lit("\n来源文件："), F.col("source"))
    block = F.concat(F.when(F.col("rank") % 2 == 0, listed).otherwise(chunk), F.lit("\n标题：title of "), F.col("source"), F.lit("\n位置：p. "), number)
    rows = hits.select("query_id", F.col("rank"), block.alias("block"))
    texts = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("text"))
    return R.source_blocks(texts, "text").select("query_id", "n", "item_id", "title", "source_file", "location")


@query(
    "r22_cap_sources",
    f"""WITH {DENSE_CTE.replace('rank <= 20', 'rank <= 60')}, x AS (SELECT query_id, key, rank, CASE WHEN rank % 4 > 0 THEN 61 - rank END AS n, key % 7 AS a, CASE WHEN key % 3 > 0 THEN label END AS b, key % 2 AS c FROM de JOIN embeddings ON vec_id = key),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, a, b, c ORDER BY rank) = 1),
z AS (SELECT *, n IS NOT NULL AND key % 4 = 1 AND query_id % 300 > 0 AS cited FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, cited ORDER BY n IS NULL, n, rank) AS slot, count(*) OVER (PARTITION BY query_id) AS total, count(*) FILTER (cited) OVER (PARTITION BY query_id) AS kept FROM z)
SELECT query_id, key, n::INTEGER AS n, cited, row_number() OVER (PARTITION BY query_id ORDER BY n IS NULL, n, rank)::INTEGER AS place FROM p WHERE total <= 20 OR cited OR slot <= 20 - kept""",
)
def r22(t: Tables) -> DataFrame:
    """Sixty hits as sources, three of four numbered; the answer of a query cites some of them in both forms, and one that is no source."""
    hits = dense(t, 60).join(t.embeddings.select(F.col("vec_id").alias("key"), "label"), "key")
    hits = hits.select("query_id", "key", "rank", F.when(F.col("rank") % 4 > 0, 61 - F.col("rank")).alias("n"), (F.col("key") % 7).alias("a"), F.when(F.col("key") % 3 > 0, F.col("label")).alias("b"), (F.col("key") % 2).alias("c"))
    form = F.when(F.col("key") % 8 == 1, F.format_string("so [%d]", "n")).otherwise(F.format_string("[资料%d].", "n"))
    unique = hits.withColumn("i", F.row_number().over(Window.partitionBy("query_id", "a", "b", "c").orderBy("rank"))).where("i = 1")
    said = F.array_join(F.collect_list(F.when((F.col("key") % 4 == 1) & F.col("n").isNotNull() & (F.col("query_id") % 300 > 0), form)), " ")
    answers = unique.groupBy("query_id").agg(F.concat(said, F.lit(" [123] [99]")).alias("text"))
    return R.cap_sources(hits, answers, "query_id", "rank", "n", ["a", "b", "c"]).select("query_id", "key", "n", "cited", "place")


@query(
    "r23_step_dedup",
    """WITH s AS (SELECT source AS run, lang AS step, doc_id AS pos, md5(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS print FROM documents),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run, print ORDER BY step, pos) = 1)
SELECT run, step, pos, row_number() OVER (PARTITION BY run, step ORDER BY pos) AS place FROM u QUALIFY place <= 5""",
)
def r23(t: Tables) -> DataFrame:
    """A text that an earlier step of the run has shown does not take a place in a later one."""
    steps = t.documents.select(F.col("source").alias("run"), F.col("lang").alias("step"), F.col("doc_id").alias("pos"), F.md5(F.regexp_replace("text", "\\s+", "")).alias("print"))
    unique = R.top(steps, ["run", "print"], ["step", "pos"], 1, "n")
    return R.top(unique, ["run", "step"], ["pos"], 5, "place").select("run", "step", "pos", F.col("place").cast("long").alias("place"))


@query(
    "r24_request_key",
    "SELECT sha256(lower(trim(event_type)) || chr(31) || user_id::VARCHAR || chr(31) || 'rev1') AS request_key, count(*)::BIGINT AS requests FROM events GROUP BY ALL",
)
def r24(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws("\x1f", F.lower(F.trim("event_type")), F.col("user_id").cast("string"), F.lit("rev1")), 256)
    return t.events.groupBy(key.alias("request_key")).agg(F.count("*").alias("requests"))


def _key_sql(text: str, item: str, min_score: str, top_k: str, revision: str, reference: str) -> str:
    number = f"CASE WHEN coalesce({top_k}, 0) = 0 THEN '' ELSE ({top_k})::VARCHAR END"
    flag = f"CASE {reference} WHEN true THEN 'True' WHEN false THEN 'False' ELSE '' END"
    score = f"CASE WHEN ({min_score}) IS NULL THEN '' ELSE printf('%.4f', {min_score}) END"
    folded = rf"trim(regexp_replace(coalesce({text}, ''), '{R.SPACES}', ' ', 'g'))"
    return f"sha256(concat_ws(chr(31), {folded}, coalesce({item}, ''), {score}, {number}, {revision}, {flag}))"


@query(
    "r24_full_key",
    f"""WITH k AS (SELECT conv_id, turn, {_key_sql('text', "CASE WHEN conv_id % 5 > 0 THEN (conv_id % 7)::VARCHAR END", "CASE WHEN turn % 3 = 1 THEN 0.35::DOUBLE WHEN turn % 3 = 2 THEN 0.2::DOUBLE END",
  "CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 0 END", "'3'", "CASE WHEN turn % 2 = 0 THEN role = 'user' END")} AS request_key FROM conversations)
SELECT request_key, count(*)::BIGINT AS requests, min(conv_id)::BIGINT AS first_conv FROM k GROUP BY request_key""",
)
def r24_full(t: Tables) -> DataFrame:
    """The turns as requests with every part of the key: item, least score, number of results, revision, reference rows or not."""
    conv, turn = F.col("conv_id"), F.col("turn")
    item = F.when(conv % 5 > 0, (conv % 7).cast("string"))
    least = F.when(turn % 3 == 1, 0.35).when(turn % 3 == 2, 0.2)
    key = R.request_key(F.col("text"), item, least, F.when(conv % 2 == 0, 5).otherwise(0), F.lit(3), F.when(turn % 2 == 0, F.col("role") == "user"))
    return t.conversations.groupBy(key.alias("request_key")).agg(F.count("*").alias("requests"), F.min(conv.cast("long")).alias("first_conv"))


TTL = 3600  # seconds that a result may be used again
EVENT_KEY_SQL = _key_sql("' ' || event_type || chr(12288) || ' list '", "floor(user_id / 10)::BIGINT::VARCHAR", "CASE WHEN event_type = 'error' THEN 0.35::DOUBLE END", "5", "'1'", "true")


@query(
    "r24_cache_stream",
    f"""WITH {anchored_sql(f'SELECT {EVENT_KEY_SQL} AS k, event_id, epoch_us(ts) AS us FROM events', TTL)}
SELECT k AS request_key, event_id, start AS written_us, row_number() OVER (PARTITION BY k, start ORDER BY us, event_id) > 1 AS hit FROM w""",
)
def r24_stream(t: Tables) -> DataFrame:
    """Requests as they come, by key: computed, or answered by a result that is less than an hour old."""
    item = F.floor(F.col("user_id") / 10).cast("string")
    text = F.concat(F.lit(" "), "event_type", F.lit("\u3000 list "))
    key = R.request_key(text, item, F.when(F.col("event_type") == "error", 0.35), F.lit(5), F.lit(1), F.lit(True))
    requests = t.events.select(key.alias("request_key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    out, state = scratch(t, "r24-hits"), scratch(t, "r24-state")
    for arrived in in_order(t, "r24-requests", requests):
        rows = S.run_with_state(S.answered_before(arrived, "request_key", "ts", TTL), out, state)
    return rows


@query("r25_card_text", "SELECT doc_id, md5(CASE WHEN lang = 'en' THEN string_split(text, ' the ')[1] ELSE text END) AS text_md5 FROM documents")
def r25(t: Tables) -> DataFrame:
    """Texts of one type are cut at a marker."""
    return t.documents.select("doc_id", F.md5(F.when(F.col("lang") == "en", F.substring_index("text", " the ", 1)).otherwise(F.col("text"))).alias("text_md5"))


@query(
    "r26_display_fields",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS type_name, coalesce(nullif(source, ''), 'untitled') AS file, concat_ws('，', 'page ' || n_chars::VARCHAR, CASE WHEN n_chars > 1000 THEN 'long' END) AS location FROM documents",
)
def r26(t: Tables) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise(F.col("lang"))
    place = F.concat_ws("，", F.concat(F.lit("page "), F.col("n_chars").cast("string")), F.when(F.col("n_chars") > 1000, "long"))
    return t.documents.select("doc_id", kind.alias("type_name"), F.coalesce(F.nullif("source", F.lit("")), F.lit("untitled")).alias("file"), place.alias("location"))


@query("r27_figure_evidence", f"WITH {DENSE_CTE} SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY de.rank) AS place FROM de JOIN embeddings e ON e.vec_id = de.key WHERE de.rank <= 8 AND e.label >= 5 QUALIFY place <= 2")
def r27(t: Tables) -> DataFrame:
    """The first two of the best eight hits that are figures (labels from 5 up here)."""
    hits = dense(t, 8).join(t.embeddings.select(F.col("vec_id").alias("key"), "label"), "key").where("label >= 5")
    return R.top(hits.drop("score"), ["query_id"], ["rank"], 2, "place").select("query_id", "key", F.col("place").cast("long").alias("place"))
