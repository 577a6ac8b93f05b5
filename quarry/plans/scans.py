"""Queries of sources and sinks. Files that they read are first written from the tables, to the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.base import Tables, query
from quarry.sources import files as S
from quarry.sources.shared import new_path


def scratch(t: Tables, name: str) -> str:
    """A new path in the shared folder."""
    return new_path(t.spark, name)


DOC = "doc_id long, text string, lang string, source string, n_chars long"


@query("s1_read_jsonl", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def s1(t: Tables) -> DataFrame:
    path = scratch(t, "s1")
    t.documents.write.json(path)
    return S.read_jsonl(t.spark, path, DOC).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("s2_read_jsonl_tolerant", "SELECT event_id FROM events WHERE event_type <> 'error'")
def s2(t: Tables) -> DataFrame:
    """Lines that are cut off (those of errors here) do not count."""
    path = scratch(t, "s2")
    line = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_type") == "error", F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return S.read_jsonl(t.spark, path, "event_id long, event_type string", tolerant=True).select("event_id")


@query("s3_read_csv", "SELECT p_partkey, p_name, p_brand FROM part")
def s3(t: Tables) -> DataFrame:
    path = scratch(t, "s3")
    S.write_csv(t.part.select("p_partkey", "p_name", "p_brand"), path)
    return S.read_csv(t.spark, path, "p_partkey long, p_name string, p_brand string")


@query("s4_first_existing", "SELECT count(*)::BIGINT AS n FROM documents")
def s4(t: Tables) -> DataFrame:
    found = S.first_existing(t.spark, [f"{t.sf_dir}/documents_v9.parquet", f"{t.sf_dir}/documents.parquet"])
    return t.spark.read.parquet(found).agg(F.count("*").alias("n"))


@query("s5_read_json_array", "SELECT conv_id, count(*)::BIGINT AS turns, max(length(text))::BIGINT AS longest FROM conversations GROUP BY conv_id")
def s5(t: Tables) -> DataFrame:
    """Files that each hold one JSON array, of the turns of some hundred conversations."""
    path = scratch(t, "s5")
    files = 1 + t.conversations.select("conv_id").distinct().count() // 200
    rows = t.conversations.groupBy((F.col("conv_id") % files).alias("file")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("value"))
    rows.write.partitionBy("file").text(path)
    flat = S.read_json_array(t.spark, path, "conv_id long, turn long, text string")
    return flat.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))


@query("s6_newest_files", "SELECT event_type AS variant, count(*) FILTER (event_type <> 'signup' OR value < 50)::BIGINT AS n FROM events GROUP BY event_type")
def s6(t: Tables) -> DataFrame:
    """Result files of two runs; of each variant the newest run counts. The second run has no signups."""
    path = scratch(t, "s6")
    kinds = t.events.select("event_id", "value", F.col("event_type").alias("kind"))
    kinds.where("value < 50").withColumn("part", F.col("kind")).write.partitionBy("part").parquet(f"{path}/run-1")
    kinds.where("kind <> 'signup'").withColumn("part", F.col("kind")).write.partitionBy("part").parquet(f"{path}/run-2")
    read = S.with_file(t.spark.read.option("recursiveFileLookup", True).parquet(path))
    return S.newest(read, F.col("kind")).groupBy("variant").agg(F.count("*").alias("n"))


@query("s7_export_vectors", "SELECT vec_id, label, len(embedding)::BIGINT AS width FROM embeddings")
def s7(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("width"))


@query("s8_split_by_type", "SELECT CASE WHEN lang = 'en' THEN 'child' ELSE 'parent' END AS chunk_type, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def s8(t: Tables) -> DataFrame:
    docs = t.documents
    child, parent = docs.where("lang = 'en'"), docs.where("not (lang <=> 'en')")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("chunk_type"), "n")
    return one(child, "child").unionByName(one(parent, "parent"))


@query("s9_versioned_table", "SELECT 2 AS version, count(*)::BIGINT AS n FROM documents")
def s9(t: Tables) -> DataFrame:
    """Two commits of a versioned table; readers see the second one."""
    from quarry.operators.sync import VersionedTable

    table = VersionedTable(t.spark, scratch(t, "s9"))
    table.commit(t.documents.where("lang = 'en'").select("doc_id"))
    table.commit(t.documents.select("doc_id"))
    return table.read().agg(F.count("*").alias("n")).select(F.lit(table.version()).alias("version"), "n")


@query("s10_append_resumable", "SELECT count(*)::BIGINT AS rows, count(DISTINCT doc_id)::BIGINT AS ids FROM documents")
def s10(t: Tables) -> DataFrame:
    """A first run that got through part of the rows, and a second one that adds the rest."""
    path = scratch(t, "s10")
    rows = t.documents.select("doc_id", "lang")
    S.append_new(rows.where("lang = 'en'"), path, "doc_id", "doc_id long, lang string")
    S.append_new(rows, path, "doc_id", "doc_id long, lang string")
    return S.read_jsonl(t.spark, path, "doc_id long, lang string").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"))


@query("s11_archive_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def s11(t: Tables) -> DataFrame:
    path = scratch(t, "s11")
    S.archive(t.events.select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), path)
    return t.spark.read.schema("event_id long, month string").json(path).groupBy("month").agg(F.count("*").alias("n"))


@query("s12_write_csv", "SELECT doc_id, lang FROM documents")
def s12(t: Tables) -> DataFrame:
    path = scratch(t, "s12")
    S.write_csv(t.documents.select("doc_id", "lang"), path)
    return S.read_csv(t.spark, path, "doc_id long, lang string")


@query(
    "s13_chat_export",
    """WITH p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER w AS question, lag(role) OVER w AS before, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(answer) AS answer_md5, md5(question) AS question_md5 FROM p WHERE role = 'assistant' AND before = 'user'""",
)
def s13(t: Tables) -> DataFrame:
    """Question and answer pairs as chat examples, written as text and read back."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t.conversations.withColumn("question", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w)).where("role = 'assistant' and before = 'user'")
    path = scratch(t, "s13")
    line = S.chat_line("Answer from the library.", F.col("question"), F.col("text"))
    pairs.select(F.to_json(F.struct("conv_id", "turn", line.alias("line"))).alias("value")).write.text(path)
    back = S.read_jsonl(t.spark, path, "conv_id long, turn long, line string")
    m = F.from_json("line", "messages array<struct<role:string,content:string>>")["messages"]
    return back.select("conv_id", "turn", F.md5(m[2]["content"]).alias("answer_md5"), F.md5(m[1]["content"]).alias("question_md5"))


@query("s14_stream_source", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def s14(t: Tables) -> DataFrame:
    """A folder of JSON lines read as a stream until it is used up."""
    from quarry.streaming.events import run_to_table

    path = scratch(t, "s14")
    t.events.select("event_id", "event_type").write.json(path)
    source = t.spark.readStream.schema("event_id long, event_type string").json(path)
    return run_to_table(source, scratch(t, "s14-out"), scratch(t, "s14-state")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "s15_file_hashes",
    """WITH f AS (SELECT page_id % (SELECT 1 + count(*) // 200 FROM pages) AS file, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY ALL)
SELECT file, strlen(content)::BIGINT AS length, sha256(content) AS sha256 FROM f""",
)
def s15(t: Tables) -> DataFrame:
    """Raw files, each of some hundred pages, are hashed whole."""
    path = scratch(t, "s15")
    files = 1 + t.pages.count() // 200
    rows = t.pages.select((F.col("page_id") % files).alias("file"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "page_id").select("file", "value").write.partitionBy("file").text(path)
    hashed = S.file_hashes(t.spark, f"{path}/*/*.txt")
    return hashed.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), "length", "sha256")


@query(
    "s16_cases_by_id",
    "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' WHEN d.doc_id % 3 = 0 THEN 'again' ELSE 'documents' END AS origin FROM (SELECT * FROM documents WHERE doc_id % 50 <> 1) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def s16(t: Tables) -> DataFrame:
    """Two case files: in the first one some ids come again further down, and some lines are cut off."""
    case = lambda origin: F.to_json(F.struct("doc_id", F.lit(origin).alias("origin")))
    whole = t.documents.select(F.lit(0).alias("part"), "doc_id", F.when(F.col("doc_id") % 50 == 1, F.left(case("documents"), F.lit(9))).otherwise(case("documents")).alias("value"))
    again = t.documents.where("doc_id % 3 = 0 and doc_id % 50 <> 1").select(F.lit(1).alias("part"), "doc_id", case("again").alias("value"))
    first, second = scratch(t, "s16-first"), scratch(t, "s16-second")
    whole.unionByName(again).coalesce(1).sortWithinPartitions("part", "doc_id").select("value").write.text(first)  # one file, in this order
    t.labels.select(case("labels").alias("value")).write.text(second)
    read = [S.read_case_lines(t.spark, path, "doc_id long, origin string") for path in (first, second)]
    return S.cases_by_id(read, "doc_id", "line")
