"""Curation queries: turns of `conversations` are questions, `labels` and `documents` are examples, `embeddings` titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import curate as D
from quarry.operators import pairs as P
from quarry.plans.base import Tables, query
from quarry.plans.corpus import SECT, sectioned
from quarry.plans.evaluation import NORM
from quarry.sources.shared import shared_folder, stored

QH = "sha1(regexp_replace(lower(trim(text)), '[\\s!-/:-@\\[-`{-~]+', '', 'g'))"
Q = f"""q AS (SELECT conv_id, turn, text, {QH.replace('sha1(', 'md5(')} AS h, CASE role WHEN 'user' THEN 0 ELSE 1 END AS pool FROM conversations)"""


def questions(t: Tables) -> DataFrame:
    h = F.md5(F.regexp_replace(F.lower(F.trim("text")), "[\\s!-/:-@\\[-`{-~]+", ""))
    return t.conversations.select("conv_id", "turn", "text", h.alias("h"), F.when(F.col("role") == "user", 0).otherwise(1).alias("pool"))


@query("d1_question_dedup", f"WITH {Q} SELECT h, pool, conv_id, turn FROM q QUALIFY row_number() OVER (PARTITION BY h ORDER BY pool, conv_id, turn) = 1")
def d1(t: Tables) -> DataFrame:
    return D.first_by_hash(questions(t).drop("text"), "h", ["pool", "conv_id", "turn"]).select("h", "pool", "conv_id", "turn")


@query(
    "d2_label_sources",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'simple_qa' WHEN 'de' THEN 'summary' ELSE 'other' END AS label, (lang = 'en') <> (quality = 1) AS review FROM documents JOIN labels USING (doc_id)",
)
def d2(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("en", "simple_qa"), ("de", "summary")], "lang string, label string")  # a fixed table
    rows = t.documents.join(t.labels, "doc_id").join(F.broadcast(names), "lang", "left")
    return rows.select("doc_id", F.coalesce("label", F.lit("other")).alias("label"), ((F.col("lang") == "en") != (F.col("quality") == 1)).alias("review"))


def alloc(name: str, rows: str, by: str, n: str) -> str:
    """SQL of `allocate`: CTEs that end in one of the given name with k and places, for the classes of a relation."""
    return f"""{name}_c AS (SELECT {by} AS k, count(*) AS c, least({n}, sum(count(*)) OVER ()) AS n, sum(count(*)) OVER () AS t FROM {rows} GROUP BY {by}),
{name}_s AS (SELECT *, least(c, greatest(1, floor(n * c / t + 0.5))) AS s, n * c / t AS ideal FROM {name}_c),
{name}_r AS (SELECT *, sum(s) OVER () - n AS surplus, row_number() OVER (ORDER BY s > 1 DESC, s - ideal DESC, k DESC) AS down, row_number() OVER (ORDER BY s < c DESC, s - ideal, k) AS up FROM {name}_s),
{name} AS (SELECT k, s - (surplus > 0 AND down <= surplus)::INTEGER + (surplus < 0 AND up <= -surplus)::INTEGER AS places FROM {name}_r)"""


def picked(rows: str, by: str, key: str, places: str, seed: str) -> str:
    """SQL of `stratified`: the rows of a relation that take the places."""
    return f"(SELECT * EXCLUDE (pk) FROM (SELECT x.*, row_number() OVER (PARTITION BY {by} ORDER BY sha1('{seed}' || {key}::VARCHAR), {key}) AS pk FROM {rows} x) JOIN {places} ON k = {by} WHERE pk <= places)"


@query("d3_stratified", f"WITH {alloc('a', 'documents', 'lang', '100')} SELECT doc_id, lang FROM {picked('documents', 'lang', 'doc_id', 'a', 's1')}")
def d3(t: Tables) -> DataFrame:
    """100 examples in proportion to their languages: the number is the feature."""
    return D.stratified(t.documents.select("doc_id", "lang"), "lang", "doc_id", 100, "s1")


TEST, VAL, CAP = 300, 150, 1200
SPLIT = f"""e AS (SELECT doc_id, lang, true AS is_real FROM labels JOIN documents USING (doc_id) WHERE quality = 1 UNION ALL SELECT -doc_id - 1, lang, false FROM documents),
re AS (SELECT * FROM e WHERE is_real), ma AS (SELECT * FROM e WHERE NOT is_real), {alloc('ta', 're', 'lang', str(TEST))}, te AS (SELECT doc_id FROM {picked('re', 'lang', 'doc_id', 'ta', 's2t')}),
rr AS (SELECT * FROM re WHERE doc_id NOT IN (SELECT doc_id FROM te)), pool AS (SELECT * FROM ma WHERE (SELECT count(*) FROM rr) < {VAL} UNION ALL SELECT * FROM rr WHERE (SELECT count(*) FROM rr) >= {VAL}),
{alloc('va', 'pool', 'lang', f'{VAL} - CASE WHEN (SELECT count(*) FROM rr) < {VAL} THEN (SELECT count(*) FROM rr) ELSE 0 END')},
vv AS (SELECT doc_id FROM {picked('pool', 'lang', 'doc_id', 'va', 's2v')} UNION ALL SELECT doc_id FROM rr WHERE (SELECT count(*) FROM rr) < {VAL}),
tr AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1('s2' || doc_id::VARCHAR), doc_id) AS n FROM ma WHERE doc_id NOT IN (SELECT doc_id FROM vv)) WHERE n <= {CAP}),
p AS (SELECT e.*, CASE WHEN te.doc_id IS NOT NULL THEN 'test' WHEN vv.doc_id IS NOT NULL THEN 'val' WHEN tr.doc_id IS NOT NULL THEN 'train' ELSE 'none' END AS split
  FROM e LEFT JOIN te ON te.doc_id = e.doc_id LEFT JOIN vv ON vv.doc_id = e.doc_id LEFT JOIN tr ON tr.doc_id = e.doc_id)"""


def splits(t: Tables) -> DataFrame:
    """Documents with a good label are the real examples, all documents (under ids of their own) the made ones."""
    real = t.labels.where("quality = 1").join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.lit(True).alias("is_real"))
    made = t.documents.select((-F.col("doc_id") - 1).alias("doc_id"), "lang", F.lit(False).alias("is_real"))
    return D.real_first(real.unionByName(made), "lang", "doc_id", "is_real", test=TEST, val=VAL, cap=CAP, seed="s2")


@query("d4_splits", f"WITH {SPLIT} SELECT doc_id, lang, is_real, split FROM p")
def d4(t: Tables) -> DataFrame:
    return splits(t)


@query("d5_spot_check", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('s3' || doc_id::VARCHAR), doc_id) <= 40")
def d5(t: Tables) -> DataFrame:
    """40 rows of each class to look at: the number is the feature."""
    order = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("s3"), F.col("doc_id").cast("string")), 256), "doc_id")
    return t.documents.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where("n <= 40").drop("n")


@query(
    "d6_distribution",
    f"WITH {SPLIT} SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (split = 'test')::BIGINT AS test, count(*) FILTER (split = 'train')::BIGINT AS train, count(*) FILTER (split = 'val')::BIGINT AS val, count(*) FILTER (split = 'none')::BIGINT AS left_over, count(*) FILTER (split = 'test' AND is_real)::BIGINT AS real_test, count(*)::BIGINT AS total FROM p GROUP BY ROLLUP (lang)",
)
def d6(t: Tables) -> DataFrame:
    counts = [F.count_if(F.col("split") == s).alias(name) for s, name in (("test", "test"), ("train", "train"), ("val", "val"), ("none", "left_over"))]
    real = F.count_if((F.col("split") == "test") & F.col("is_real")).alias("real_test")
    return splits(t).rollup("lang").agg(*counts, real, F.count("*").alias("total")).withColumn("lang", F.coalesce("lang", F.lit("all")))


HOLD = """n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY sha1('s4' || conv_id::VARCHAR), conv_id, turn) AS n, ceil(count(*) OVER (PARTITION BY role) * 2 / 10) AS most FROM conversations),
h AS (SELECT conv_id, turn, role FROM n WHERE n <= most)"""


@query("d7_group_hold_out", f"WITH {HOLD} SELECT conv_id, turn, role, 'held' AS split FROM h UNION ALL SELECT conv_id, turn, role, 'train' FROM n WHERE conv_id NOT IN (SELECT conv_id FROM h)")
def d7(t: Tables) -> DataFrame:
    """A fifth of each class is held out by conversation; training keeps nothing of a held conversation."""
    held, train = D.hold_out(t.conversations.select("conv_id", "turn", "role"), "role", "conv_id", 2, "s4")
    return train.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("held")))


@query(
    "d8_variant_filter",
    f"""WITH {Q}, s AS (SELECT *, length(text) BETWEEN 4 AND 120 AS fits, length(text) % 7 = 0 AS other_label FROM q WHERE pool = 1), seeds AS (SELECT DISTINCT h FROM q WHERE pool = 0),
k AS (SELECT *, fits AND NOT other_label AND h NOT IN (SELECT h FROM seeds) AS candidate FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY h, candidate ORDER BY conv_id, turn) AS n FROM k)
SELECT conv_id, turn, CASE WHEN NOT fits THEN 'length' WHEN other_label THEN 'label' WHEN NOT candidate THEN 'seed' WHEN n > 1 THEN 'repeat' ELSE 'kept' END AS reason FROM n""",
)
def d8(t: Tables) -> DataFrame:
    """Why a variant (an answer here) is dropped: length, its own label differs, equal to a seed, seen before among those that are left."""
    variants = questions(t).where("pool = 1").withColumn("own", F.when(F.length("text") % 7 == 0, "other").otherwise("same"))
    return D.variant_filter(variants, questions(t).where("pool = 0"), "h", ["conv_id", "turn"], "text", F.col("own") == "same").select("conv_id", "turn", "reason")


STOP = ", ".join(f"'{w}'" for w in D.KEYWORD_STOPWORDS)
WORDY = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda x: length(x) >= {D.LEAST_KEYWORD} AND x NOT IN ({STOP}))))"


@query(
    "d9_keywords",
    f"""WITH w AS (SELECT item_id, {WORDY.format('b.text')} AS k, {NORM.format('d.text')} AS s FROM benchmark b LEFT JOIN documents d ON doc_id = item_id),
m AS (SELECT *, list_filter(k, lambda x: NOT contains(s, x)) AS missing FROM w)
SELECT item_id, array_to_string(k, ',') AS keywords, len(k) >= 2 AS enough, array_to_string(missing, ',') AS missing, len(k) > 0 AND 1 - len(missing) / greatest(len(k), 1) >= 1 - 0.34::DOUBLE AS verified FROM m""",
)
def d9(t: Tables) -> DataFrame:
    """The keywords of each passage, and if they hold in its source (the document of the same id here)."""
    source = t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("source"))
    rows = t.benchmark.select("item_id", F.array_sort(D.kept_keywords(F.array_distinct(X.tokens(F.col("text"))))).alias("k")).join(source, "item_id", "left")
    lost = F.array_join(D.missing_keywords(F.col("k"), F.col("source")), ",")
    return rows.select("item_id", F.array_join("k", ",").alias("keywords"), (F.size("k") >= 2).alias("enough"), lost.alias("missing"), D.keywords_hold(F.col("k"), F.col("source")).alias("verified"))


def _gram_sql(table: str, key: str) -> str:
    words = f"list_filter(string_split({NORM.format('text').replace(chr(39) * 2 + ', ' + chr(39) + 'g', chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g')}, ' '), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(k[i:i + 4], ' ') AS g FROM (SELECT {key}, {words} AS k FROM {table}), unnest(range(1, greatest(len(k) - 3, 1))) AS r(i)"


@query(
    "d10_overlap",
    f"""WITH q AS ({_gram_sql('benchmark', 'item_id')}), s AS ({_gram_sql('documents', 'doc_id')}),
p AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN s USING (g) GROUP BY ALL), b AS (SELECT item_id, count(*) AS sources, min_by(doc_id, (-shared, doc_id)) AS nearest, max(shared) AS shared FROM p GROUP BY item_id),
n AS (SELECT i.item_id, count(q.g) AS grams FROM benchmark i LEFT JOIN q ON q.item_id = i.item_id GROUP BY i.item_id)
SELECT item_id, grams::INTEGER AS grams, coalesce(sources, 0)::BIGINT AS sources, nearest, coalesce(shared, 0)::BIGINT AS shared, coalesce(shared, 0) <= grams * 0.65::DOUBLE AS kept FROM n LEFT JOIN b USING (item_id)""",
)
def d10(t: Tables) -> DataFrame:
    """How much of each passage stands in a document, by 5-grams of words."""
    return D.question_overlap(t.benchmark, t.documents, key="item_id", question="text", source_key="doc_id", source="text")


@query(
    "d11_capped_sample",
    f"""WITH {SECT}, x AS (SELECT doc_id, ord, length(s.text) % 5 = 0 AS special, sha256(doc_id::VARCHAR || '-' || ord::VARCHAR) AS h, lang = 'de' AS wide FROM s JOIN documents USING (doc_id)),
e1 AS (SELECT * FROM (SELECT * FROM x WHERE wide QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, ord) <= 6) ORDER BY h, doc_id, ord LIMIT 90),
e2 AS (SELECT * FROM (SELECT * FROM x WHERE wide IS NOT true QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, ord) <= 3) ORDER BY h, doc_id, ord LIMIT 90),
u AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
e3 AS (SELECT * FROM (SELECT * FROM x WHERE special AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = x.doc_id AND u.ord = x.ord) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, ord) <= 2) ORDER BY h, doc_id, ord LIMIT 20)
SELECT doc_id, ord, CASE WHEN wide THEN 'wide' ELSE 'other' END AS part FROM u UNION ALL SELECT doc_id, ord, 'special' FROM e3""",
)
def d11(t: Tables) -> DataFrame:
    """Three draws, one after the other: six chunks a document of the language with few documents, three of the others, then two of a
    special kind from what is not used yet."""
    h = F.sha2(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")), 256)
    wide = t.documents.select("doc_id", F.coalesce(F.col("lang") == "de", F.lit(False)).alias("wide"))
    rows = sectioned(t).select("doc_id", "ord", (F.length("text") % 5 == 0).alias("special")).join(wide, "doc_id")
    key = ["doc_id", "ord"]
    first = D.capped_sample(rows.where("wide"), "doc_id", key, h, cap=6, n=90).withColumn("part", F.lit("wide"))
    first = first.unionByName(D.capped_sample(rows.where("not wide"), "doc_id", key, h, cap=3, n=90).withColumn("part", F.lit("other")))
    used = stored(first.select(*key, "part"), "d11")
    special = D.capped_sample(rows.where("special"), "doc_id", key, h, cap=2, n=20, used=used)
    return used.unionByName(special.select(*key, F.lit("special").alias("part")))


QUOTA = f"""{SECT}, q0 AS (SELECT doc_id, ord, CASE WHEN count(*) OVER (PARTITION BY block_type) < 20 THEN 'other' ELSE block_type END AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM s),
q AS (SELECT doc_id, ord, kind, concat_ws('-', doc_id, ord) AS key FROM q0 WHERE i <= 2), {alloc('a', 'q', 'kind', '60')}"""


@query("d12_quota_sample", f"WITH {QUOTA} SELECT doc_id, ord, kind FROM {picked('q', 'kind', 'key', 'a', 's5')}")
def d12(t: Tables) -> DataFrame:
    """60 chunks shared out over block types, rare types merged, two a document at most: the numbers are the caller's."""
    rows = sectioned(t).select("doc_id", "ord", "block_type")
    counts = rows.groupBy("block_type").agg(F.count("*").alias("c"))
    kind = F.when(F.col("c") < 20, "other").otherwise(F.col("block_type"))
    merged = rows.join(F.broadcast(counts), "block_type").select("doc_id", "ord", kind.alias("kind"))
    capped = merged.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where("n <= 2").drop("n")
    return D.stratified(capped.withColumn("key", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string"))), "kind", "key", 60, "s5").drop("key")


def _checkpoint(spark):
    """Writes each round to the session's shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint()


PAIR_LEAST = 0.3


@query("d13_greedy_pairs")
def d13(t: Tables) -> DataFrame:
    return P.greedy_pairs(t.embeddings, "vec_id", "embedding", PAIR_LEAST)


@query("d14_seed_clusters")
def d14(t: Tables) -> DataFrame:
    """Clusters of three at most, made by the seeds in id order."""
    clusters = P.seed_clusters(t.embeddings, "vec_id", "embedding", PAIR_LEAST, 3)
    return clusters.select("seed", F.col("member").alias("vec_id"), "score")


@query(
    "d15_templated_cases",
    """WITH r AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part),
b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 2 ORDER BY n DESC, p_brand LIMIT 8)
SELECT 'reader' AS template, p_partkey::VARCHAR AS subject, 'Who presented "' || p_name || '"?' AS question, p_brand AS answer FROM r WHERE p_brand <> ''
UNION ALL SELECT 'link', p_partkey::VARCHAR, 'What is the type of "' || p_name || '"?', p_type FROM r WHERE p_type <> ''
UNION ALL SELECT 'by_reader', p_brand, 'What did ' || p_brand || ' present?', n::VARCHAR FROM b
UNION ALL SELECT 'summary', p_partkey::VARCHAR, 'Summarise "' || p_name || '".', p_partkey::VARCHAR FROM r WHERE p_size > 40
UNION ALL SELECT 'pair', p_partkey::VARCHAR, 'Compare "' || p_name || '" with "' || next || '".', p_name || ';' || next FROM r WHERE next IS NOT NULL
UNION ALL SELECT 'group', n_name, 'Report on the suppliers from ' || n_name || '.', count(s_suppkey)::VARCHAR FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def d15(t: Tables) -> DataFrame:
    """Six kinds of cases from the catalog: readers, links, what a reader presented (the eight with most), summaries, pairs, groups."""
    follower = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    parts = t.part.select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_name", "p_brand", "p_type", "p_size", follower.alias("next"))
    most = t.part.groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "p_brand").limit(8)
    groups = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.count("s_suppkey").cast("string").alias("n"))
    return D.templated(
        [
            ("reader", parts.where("p_brand <> ''"), "key", 'Who presented "%s"?', ["p_name"], F.col("p_brand")),
            ("link", parts.where("p_type <> ''"), "key", 'What is the type of "%s"?', ["p_name"], F.col("p_type")),
            ("by_reader", most, "p_brand", "What did %s present?", ["p_brand"], F.col("n").cast("string")),
            ("summary", parts.where("p_size > 40"), "key", 'Summarise "%s".', ["p_name"], F.col("key")),
            ("pair", parts.where("next is not null"), "key", 'Compare "%s" with "%s".', ["p_name", "next"], F.concat_ws(";", "p_name", "next")),
            ("group", groups, "n_name", "Report on the suppliers from %s.", ["n_name"], F.col("n")),
        ]
    )


PRONOUN = "(^|\\s)(it|this|that|le|der)(\\s|$)"


@query(
    "d16_three_turns",
    rf"""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, max_by(text, turn) AS answer, min_by(text, turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT conv_id, max(text) FILTER (n = 1) AS one, max(text) FILTER (n = 2) AS two, max(text) FILTER (n = 3) AS three FROM u GROUP BY conv_id),
c AS (SELECT p.*, answer, {NORM.format('said')} AS folded, {WORDY.format('answer')} AS k, CASE WHEN p.conv_id % 3 = 0 THEN left(d.text, 20) ELSE substr(one, 4, 20) END AS title FROM p LEFT JOIN a USING (conv_id) LEFT JOIN documents d ON doc_id = conv_id)
SELECT conv_id, coalesce(trim(one) <> '' AND trim(two) <> '' AND trim(three) <> '' AND trim(answer) <> '' AND len(k) >= 2 AND title <> '' AND contains(one, left(title, 8)) AND regexp_matches(lower(three), '(^|\s)(it|this|that|le|der)(\s|$)'), false) AS good,
  coalesce(len(k) > 0 AND 1 - len(list_filter(k, lambda x: NOT contains(folded, x))) / greatest(len(k), 1) >= 1 - 0.34::DOUBLE, false) AS verified FROM c""",
)
def d16(t: Tables) -> DataFrame:
    """The first three questions of a conversation as a case; the title is that of a document, or words of the first question."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = t.conversations.where("role = 'user'").select("conv_id", "text", n.alias("n"))
    p = asked.groupBy("conv_id").agg(*[F.max(F.when(F.col("n") == i, F.col("text"))).alias(name) for i, name in enumerate(("one", "two", "three"), 1)])
    said = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.min_by("text", "turn").alias("said"))
    titles = t.documents.select(F.col("doc_id").alias("conv_id"), F.left("text", F.lit(20)).alias("t"))
    c = p.join(said, "conv_id", "left").join(titles, "conv_id", "left")
    title = F.when(F.col("conv_id") % 3 == 0, F.col("t")).otherwise(F.substring("one", 4, 20))
    c = c.withColumn("words", D.kept_keywords(F.array_distinct(X.tokens(F.col("answer")))))
    words = F.col("words")
    good = D.three_turn_case(F.array("one", "two", F.lower("three")), title, F.col("answer"), words, PRONOUN)
    return c.select("conv_id", good.alias("good"), F.coalesce(D.keywords_hold(words, F.col("said")), F.lit(False)).alias("verified"))
