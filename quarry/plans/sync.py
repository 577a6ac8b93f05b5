"""Sync queries.

The ledger holds the labelled documents; the current snapshot all documents but those labelled as of low quality; the text of
toxic ones has changed since. So new, changed, restored, unchanged and missing rows all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import sync as Y
from quarry.plans.base import Tables, query
from quarry.plans.retrieval import BM25_CTE
from quarry.plans.scans import scratch


def written(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that lineage does not grow."""
    path = scratch(t, name)
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


BASE = """
ledger AS (SELECT DISTINCT d.doc_id, source, md5(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS print,
  CASE WHEN length(text) < 200 THEN 'suspect_missing' ELSE 'active' END AS status, CASE WHEN length(text) < 200 THEN 1 ELSE 0 END AS missing_count
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
snap AS (SELECT doc_id, source, md5(text) AS print FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM low)),
df AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.print IS NULL THEN 'new' WHEN n.print IS NULL THEN 'missing' WHEN status <> 'active' THEN 'restored'
  WHEN o.print <> n.print THEN 'changed' ELSE 'unchanged' END AS outcome FROM ledger o FULL JOIN snap n ON o.doc_id = n.doc_id)"""


def ledger(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    short = F.length("text") < 200
    return t.documents.join(marks, "doc_id").select(
        "doc_id", "source", F.md5(text).alias("print"), F.when(short, "suspect_missing").otherwise("active").alias("status"), F.when(short, 1).otherwise(0).alias("missing_count")
    )


def snapshot(t: Tables) -> DataFrame:
    low = t.labels.where("quality = 0").select("doc_id")
    return t.documents.join(low, "doc_id", "left_anti").select("doc_id", "source", F.md5("text").alias("print"))


def outcomes(t: Tables) -> DataFrame:
    return Y.diff(ledger(t), snapshot(t), "doc_id", "print")


@query("y1_stable_id", "SELECT doc_id, left(sha256('tenant:' || doc_id::VARCHAR), 16) AS item_id, sha256(concat_ws(chr(31), source, lang, n_chars::VARCHAR)) AS fingerprint FROM documents")
def y1(t: Tables) -> DataFrame:
    print_ = F.sha2(F.concat_ws("\x1f", "source", "lang", F.col("n_chars").cast("string")), 256)
    return t.documents.select("doc_id", Y.stable_id(F.lit("tenant"), F.col("doc_id").cast("string")).alias("item_id"), print_.alias("fingerprint"))


@query("y2_scan_filter", "SELECT source, count(*)::BIGINT AS seen, count(*) FILTER (lang IN ('en', 'de') AND length(text) > 0)::BIGINT AS taken, count(*) FILTER (lang NOT IN ('en', 'de'))::BIGINT AS wrong_type FROM documents GROUP BY source")
def y2(t: Tables) -> DataFrame:
    good = F.col("lang").isin("en", "de")
    return t.documents.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(good & (F.length("text") > 0)).alias("taken"), F.count_if(~good).alias("wrong_type"))


@query("y3_snapshot_diff", f"WITH {BASE} SELECT doc_id, outcome FROM df")
def y3(t: Tables) -> DataFrame:
    return outcomes(t).select("doc_id", "outcome")


def _missing(strikes: int) -> str:
    return f"""WITH {BASE} SELECT doc_id, CASE WHEN missing_count + 1 >= {strikes} THEN 'soft_deleted' ELSE 'suspect_missing' END AS status, (missing_count + 1)::INTEGER AS missing_count
FROM ledger WHERE doc_id NOT IN (SELECT doc_id FROM snap)"""


@query("y4_missing_two_strikes", _missing(2))
def y4(t: Tables) -> DataFrame:
    return Y.strike(ledger(t), snapshot(t), "doc_id").select("doc_id", "status", "missing_count")


@query("y5_missing_one_strike", _missing(1))
def y5(t: Tables) -> DataFrame:
    return Y.strike(ledger(t), snapshot(t), "doc_id", strikes=1).select("doc_id", "status", "missing_count")


HEALTHY = "ok AS (SELECT source FROM documents GROUP BY source HAVING avg(n_chars) < 2500)"


@query("y6_root_isolation", f"WITH {BASE}, {HEALTHY} SELECT doc_id, source FROM ledger WHERE source IN (SELECT source FROM ok) AND doc_id NOT IN (SELECT doc_id FROM snap)")
def y6(t: Tables) -> DataFrame:
    """Sources that failed their scan (here: by their mean length) are left out of missing detection."""
    healthy = t.documents.groupBy("source").agg(F.avg("n_chars").alias("a")).where("a < 2500").select("source")
    return Y.strike(ledger(t).join(healthy, "source", "left_semi"), snapshot(t), "doc_id").select("doc_id", "source")


@query(
    "y7_work_list",
    f"""WITH {BASE}, jobs AS (SELECT doc_id, print, CASE WHEN status = 'active' THEN 'completed' ELSE 'running' END AS status FROM ledger)
SELECT coalesce(j.doc_id, s.doc_id) AS doc_id, coalesce(j.print, s.print) AS print,
  CASE WHEN j.doc_id IS NULL OR (j.status = 'completed' AND s.source = 'src1') THEN 'pending' ELSE j.status END AS status,
  CASE WHEN j.doc_id IS NULL OR (j.status = 'completed' AND s.source = 'src1') THEN 0 ELSE 1 END AS attempts
FROM jobs j FULL JOIN snap s ON j.doc_id = s.doc_id AND j.print = s.print""",
)
def y7(t: Tables) -> DataFrame:
    """One job for each document and content. All rows of a snapshot ask for theirs; those of one source are to be done again."""
    jobs = ledger(t).select("doc_id", "print", F.when(F.col("status") == "active", "completed").otherwise("running").alias("status"), F.lit(1).alias("attempts"))
    now, key = snapshot(t), ["doc_id", "print"]
    jobs = Y.enqueue(jobs, now, key)
    return Y.enqueue(jobs, now.where("source = 'src1'"), key, revive=True)


@query("y8_content_short_cut", f"WITH {BASE} SELECT s.doc_id, CASE WHEN o.print = s.print THEN 'skip' ELSE 'process' END AS action FROM snap s LEFT JOIN ledger o USING (doc_id)")
def y8(t: Tables) -> DataFrame:
    old = ledger(t).select("doc_id", F.col("print").alias("old"))
    return snapshot(t).join(old, "doc_id", "left").select("doc_id", F.when(F.col("old") == F.col("print"), "skip").otherwise("process").alias("action"))


@query("y9_need_ingest", f"WITH {BASE} SELECT s.doc_id, CASE WHEN o.print IS NULL THEN 'new' WHEN s.source = 'src1' THEN 'forced' WHEN o.print <> s.print THEN 'changed' ELSE 'unchanged' END AS reason FROM snap s LEFT JOIN ledger o USING (doc_id)")
def y9(t: Tables) -> DataFrame:
    old = ledger(t).select("doc_id", F.col("print").alias("old"))
    reason = F.when(F.col("old").isNull(), "new").when(F.col("source") == "src1", "forced").when(F.col("old") != F.col("print"), "changed").otherwise("unchanged")
    return snapshot(t).join(old, "doc_id", "left").select("doc_id", reason.alias("reason"))


@query("y10_manifest", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (true) IS NOT NULL AS present FROM events GROUP BY user_id")
def y10(t: Tables) -> DataFrame:
    last = Y.last_write(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    return last.select("user_id", "event_type", F.lit(True).alias("present"))


@query("y11_restore", f"WITH {BASE} SELECT doc_id, 'active' AS status, 0 AS missing_count FROM df WHERE outcome = 'restored'")
def y11(t: Tables) -> DataFrame:
    return outcomes(t).where("outcome = 'restored'").select("doc_id", F.lit("active").alias("status"), F.lit(0).alias("missing_count"))


WORK = """jobs AS (SELECT doc_id, 'upsert' AS job_type, md5(source) AS target, CASE WHEN status = 'active' THEN 'completed' ELSE 'running' END AS status FROM ledger
  UNION ALL SELECT doc_id, 'mark_missing', md5(source), 'failed' FROM ledger WHERE source = 'src1')"""


def work(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The ledger with its metadata hash, and a work list: an upsert of every row; removals of one source have failed before."""
    rows = ledger(t).withColumn("target", F.md5("source"))
    job = lambda df, kind, status: df.select("doc_id", F.lit(kind).alias("job_type"), "target", status.alias("status"), F.lit(1).alias("attempts"))
    jobs = job(rows, "upsert", F.when(F.col("status") == "active", "completed").otherwise("running"))
    return rows, jobs.unionByName(job(rows.where("source = 'src1'"), "mark_missing", F.lit("failed")))


@query(
    "y12_delete_by_event",
    f"""WITH {BASE}, {WORK}, gone AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), hit AS (SELECT doc_id, md5(source) AS target FROM ledger WHERE doc_id IN (SELECT user_id FROM gone))
SELECT 'ledger' AS part, doc_id, NULL AS job_type, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN 'soft_deleted' ELSE status END AS status, NULL::INTEGER AS attempts FROM ledger
UNION ALL SELECT 'job', doc_id, job_type, CASE WHEN job_type = 'mark_missing' AND doc_id IN (SELECT doc_id FROM hit) THEN 'pending' ELSE status END,
  CASE WHEN job_type = 'mark_missing' AND doc_id IN (SELECT doc_id FROM hit) THEN 0 ELSE 1 END FROM jobs
UNION ALL SELECT 'job', doc_id, 'mark_missing', 'pending', 0 FROM hit WHERE doc_id NOT IN (SELECT doc_id FROM jobs WHERE job_type = 'mark_missing')""",
)
def y12(t: Tables) -> DataFrame:
    """Delete events (errors, by the id of their user) mark rows of the ledger and ask for their removal; they come twice here."""
    rows, jobs = work(t)
    gone = t.events.where("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    for _ in range(2):
        rows, jobs = Y.delete_by_event(rows, jobs, gone, "doc_id", "target")
    out = rows.select(F.lit("ledger").alias("part"), "doc_id", "status")
    return out.unionByName(jobs.select(F.lit("job").alias("part"), "doc_id", "job_type", "status", "attempts"), allowMissingColumns=True)


PURGE = """x AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events),
busy AS (SELECT DISTINCT user_id FROM events, m WHERE event_type = 'error' AND ts > now - INTERVAL 1 DAY)"""


@query("y13_purge", f"WITH {PURGE} SELECT user_id, CASE WHEN last < now - INTERVAL 1 HOUR AND user_id NOT IN (SELECT user_id FROM busy) THEN 'purged' ELSE 'kept' END AS status FROM x, m")
def y13(t: Tables) -> DataFrame:
    """Rows older than their grace time are purged unless a delete job of theirs is still open."""
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    dated = t.events.crossJoin(F.broadcast(now))
    busy = dated.where("event_type = 'error' and ts > now - interval 1 day").select("user_id").distinct().withColumn("busy", F.lit(True))
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now)).join(busy, "user_id", "left")
    old = F.expr("last < now - interval 1 hour and busy is null")
    return last.select("user_id", F.when(old, "purged").otherwise("kept").alias("status"))


@query(
    "y14_replace_items",
    f"""WITH {BASE}, u AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.print, o.print) AS print, coalesce(CASE WHEN n.source <> 'src1' THEN n.source END, o.source) AS source,
  CASE WHEN o.doc_id IS NULL THEN 'append' WHEN n.doc_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM ledger o FULL JOIN snap n ON o.doc_id = n.doc_id)
SELECT 'rows' AS part, doc_id, print, NULL AS source, NULL AS action FROM snap UNION ALL SELECT 'rows', doc_id, print, NULL, NULL FROM ledger WHERE doc_id NOT IN (SELECT doc_id FROM snap)
UNION ALL SELECT 'catalog', doc_id, print, source, action FROM u""",
)
def y14(t: Tables) -> DataFrame:
    """Rows of items are replaced; the catalog takes new values over, but keeps an old one where the new one is blank."""
    rows = Y.replace_items(ledger(t).select("doc_id", "print"), snapshot(t).select("doc_id", "print"), "doc_id")
    old = ledger(t).select("doc_id", "print", "source")
    new = snapshot(t).select("doc_id", "print", F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("source"))
    sides = old.select("doc_id", F.lit(True).alias("was")).join(new.select("doc_id", F.lit(True).alias("comes")), "doc_id", "full")
    action = F.when(F.col("was").isNull(), "append").when(F.col("comes").isNull(), "keep").otherwise("update")
    catalog = Y.upsert(old, new, "doc_id").join(sides.select("doc_id", action.alias("action")), "doc_id")
    return rows.withColumn("part", F.lit("rows")).unionByName(catalog.withColumn("part", F.lit("catalog")), allowMissingColumns=True)


@query("y15_remove_items", f"WITH {BASE} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM low) THEN 'archived' ELSE 'kept' END AS place FROM ledger")
def y15(t: Tables) -> DataFrame:
    """Removed rows go to the archive, the others to the next version."""
    low = t.labels.where("quality = 0").select("doc_id").distinct()
    archived = ledger(t).join(low, "doc_id", "left_semi").select("doc_id", F.lit("archived").alias("place"))
    return archived.unionByName(ledger(t).join(low, "doc_id", "left_anti").select("doc_id", F.lit("kept").alias("place")))


@query("y16_drift", "SELECT source, count(*)::BIGINT AS expected, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels))::BIGINT AS actual FROM documents GROUP BY source HAVING expected <> actual")
def y16(t: Tables) -> DataFrame:
    return Y.drift(t.documents, t.documents.join(t.labels, "doc_id", "left_semi"), "source")


LINES = "lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS r(i))"


@query(
    "y16_repair",
    f"""WITH {BASE}, {LINES}, drift AS (SELECT doc_id, count(*) FILTER (length(line) > 0) AS e, count(*) FILTER (length(line) > 0 AND length(line) % 41 > 0) AS a FROM lines GROUP BY doc_id HAVING e <> a),
{WORK}, fix AS (SELECT doc_id FROM ledger WHERE status = 'active' AND doc_id IN (SELECT doc_id FROM drift))
SELECT o.doc_id, CASE WHEN f.doc_id IS NULL THEN print ELSE '' END AS print, CASE WHEN f.doc_id IS NULL THEN j.status ELSE 'pending' END AS job, CASE WHEN f.doc_id IS NULL THEN 1 ELSE 0 END AS attempts,
  CASE WHEN f.doc_id IS NULL THEN 0 ELSE 1 END AS repairs FROM ledger o JOIN jobs j ON j.doc_id = o.doc_id AND job_type = 'upsert' LEFT JOIN fix f ON f.doc_id = o.doc_id""",
)
def y16_repair(t: Tables) -> DataFrame:
    """The index has lost chunks (lines of some lengths). Two rounds of repair come after each other; the second has nothing left to do."""
    chunks = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0")
    off = Y.drift(chunks, chunks.where("length(line) % 41 > 0"), "doc_id")
    rows, jobs = work(t)
    rows, jobs, first = Y.repair(rows, jobs, off, "doc_id", "print", "target")
    rows, jobs, second = Y.repair(rows, jobs, off, "doc_id", "print", "target")
    count = first.unionByName(second).groupBy("doc_id").agg(F.count("*").cast("int").alias("repairs"))
    upserts = jobs.where("job_type = 'upsert'").select("doc_id", F.col("status").alias("job"), "attempts")
    return rows.select("doc_id", "print").join(upserts, "doc_id").join(count, "doc_id", "left").fillna(0, ["repairs"])


@query(
    "y17_revision",
    "SELECT source, (1 + max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) + max(CASE WHEN lang IS NULL OR lang <> 'en' THEN 1 ELSE 0 END))::INTEGER AS revision, count(*)::BIGINT AS rows FROM documents GROUP BY source",
)
def y17(t: Tables) -> DataFrame:
    """The revision of each source goes up by one with every commit that changes a row of it, and with no other."""
    from quarry.operators.sync import VersionedTable

    table, state = VersionedTable(t.spark, scratch(t, "y17")), VersionedTable(t.spark, scratch(t, "y17-revisions"))
    key, rows = ["source", "doc_id"], t.documents.select("source", "doc_id", "lang")
    state.commit(rows.select("source").distinct().withColumn("revision", F.lit(1)))
    table.commit(rows.limit(0))
    for new in (rows.where("lang = 'en'"), rows, rows):  # the third commit changes nothing
        old = table.read().withColumn("was", F.lit(True))
        changed = new.withColumn("comes", F.lit(True)).join(old.drop("lang"), key, "full").where("was is null or comes is null").select("source").distinct()
        state.commit(state.read().join(changed.withColumn("more", F.lit(1)), "source", "left").select("source", (F.col("revision") + F.coalesce("more", F.lit(0))).alias("revision")))
        table.commit(new)
    return table.read().groupBy("source").agg(F.count("*").alias("rows")).join(state.read(), "source")


@query(
    "y18_load_gates",
    """SELECT name, b AS broken, b = 0 AS ok FROM (SELECT 'rows' AS name, count(*)::BIGINT AS b FROM documents WHERE text IS NULL
UNION ALL SELECT 'orphan_labels', count(*)::BIGINT FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unlabelled', count(*)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'length', count(*)::BIGINT FROM documents WHERE length(text) <> n_chars)""",
)
def y18(t: Tables) -> DataFrame:
    """Expectations of a load: rows present, references whole both ways, counts as stated."""
    checks = [
        Y.expectation("rows", t.documents, F.col("text").isNull()),
        Y.expectation("orphan_labels", t.labels.join(t.documents, "doc_id", "left_anti")),
        Y.expectation("unlabelled", t.documents.join(t.labels, "doc_id", "left_anti")),
        Y.expectation("length", t.documents, F.length("text") != F.col("n_chars")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


TITLE = "regexp_replace(left(text, 60), '\\s+', ' ', 'g')"


@query(
    "y18_checked_load",
    f"""WITH {LINES}, load AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
titles AS (SELECT doc_id AS item_id, {TITLE} AS text FROM load WHERE doc_id % 100 = 0 AND text IS NOT NULL), {BM25_CTE.replace('benchmark', 'titles')}
SELECT name, b AS broken, b = 0 AS ok FROM (
  SELECT 'children' AS name, count(*)::BIGINT AS b FROM load WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE length(line) > 0)
  UNION ALL SELECT 'references', count(*)::BIGINT FROM lines WHERE length(line) = 0 AND doc_id IN (SELECT doc_id FROM load)
  UNION ALL SELECT 'title_search', count(*)::BIGINT FROM titles WHERE item_id NOT IN (SELECT key FROM bm WHERE rank <= 3 AND query_id = key)
  UNION ALL SELECT 'count_back', 0 UNION ALL SELECT 'others', 0)""",
)
def y18_checked(t: Tables) -> DataFrame:
    """The load of the documents that are new (without labels) or toxic into a table of lines. Parents name their empty lines too."""
    from quarry.operators import gates
    from quarry.operators import index as I
    from quarry.plans.retrieval import forward

    old = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = t.documents.select("doc_id", "text").join(old, "doc_id", "left")
    number = lambda p: F.concat(F.col("item").cast("string"), F.lit(p))
    lines = docs.select(F.col("doc_id").alias("item"), "toxic", F.posexplode(F.split("text", "\n")).alias("i", "text")).where("length(text) > 0")
    lines = lines.select("item", "toxic", F.concat(number("_c"), F.col("i").cast("string")).alias("chunk_id"), number("_p").alias("parent_id"), "text")
    table = Y.VersionedTable(t.spark, scratch(t, "y18"))
    table.commit(lines.where("toxic is not null").drop("toxic"))
    due = docs.where("toxic is null or toxic = 1").select(F.col("doc_id").alias("item"), "text")
    ids = F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), lambda i: F.concat(number("_c"), i.cast("string")))
    parents = due.where("text is not null").select("item", number("_p").alias("chunk_id"), ids.alias("child_ids"))
    items = due.select("item", F.when(F.col("item") % 100 == 0, F.regexp_replace(F.left("text", F.lit(60)), "\\s+", " ")).alias("title"))

    def find(asked: DataFrame) -> DataFrame:
        hits = I.bm25(asked, forward(t), query_key="item", query_text="title", k=3)
        return hits.select(F.col("query_id").alias("item"), F.col("key").alias("found"))

    return gates.load(table, lines.where("toxic is null or toxic = 1").drop("toxic"), parents, items, find)


@query("y19_status_rollup", f"WITH {BASE} SELECT status, source, count(*)::BIGINT AS n FROM ledger GROUP BY ROLLUP (status, source)")
def y19(t: Tables) -> DataFrame:
    return ledger(t).rollup("status", "source").agg(F.count("*").alias("n"))


@query(
    "y20_tree_walk",
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'root', 'r' || r_regionkey FROM region UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'c' || (s_suppkey // 2) FROM supplier UNION ALL SELECT 'c' || s_suppkey, 'c' || (s_suppkey // 2) FROM supplier),
w AS (SELECT 'root' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM w JOIN e ON e.parent = w.node WHERE depth < 60) SELECT node, min(depth) AS depth FROM w GROUP BY node""",
)
def y20(t: Tables) -> DataFrame:
    """Regions, nations and suppliers, and from each supplier a chain of halved numbers, walked until a level is empty."""
    edge = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = edge(t.region, F.lit("root"), name("r", "r_regionkey")).unionByName(edge(t.nation, name("r", "n_regionkey"), name("n", "n_nationkey")))
    edges = edges.unionByName(edge(t.supplier, name("n", "s_nationkey"), name("s", "s_suppkey")))
    half = F.concat(F.lit("c"), F.expr("cast(s_suppkey div 2 as string)"))  # chains of halves that end in a loop at c0
    edges = edges.unionByName(edge(t.supplier, name("s", "s_suppkey"), half)).unionByName(edge(t.supplier, name("c", "s_suppkey"), half))
    return Y.reachable(edges, edges.where("parent = 'root'").select(F.col("parent").alias("node")), lambda df: written(t, df, "y20"))
