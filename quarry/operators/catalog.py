"""Catalog: extraction from notes, entity matching, overrides and look-ups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.names import most_similar
from quarry.operators.ranks import running

GENERIC = ("article", "manuscript", "paper")


# The forms of numbered and plain headings, titles that head no item, forms of readers and links, names of a status.
NUMBERED = "^\\s*(?:[-*+]\\s*)?(?:#{1,6}\\s*)?(?:\\*\\*)?\\s*(\\d{1,3})\\s*(?:\\\\?\\.|．|、|\\)|）)\\s*(.+?)\\s*(?:\\*\\*)?\\s*$"
HEADING = "^\\s*(?:#{1,6}\\s+|\\*\\*)(.+?)(?:\\*\\*)?\\s*$"
NO_TITLES = ("信息分化-文献阅读分享笔记", "信息分化文献阅读分享笔记", "目录", "阅读笔记")
SAMPLE_TITLE = "样例"
READERS = ("阅读整理者[：:][ \\t]*(.+)", "阅读者[：:][ \\t]*(.+)", "分享人[：:][ \\t]*(.+)")
DOI_LINK, DOI_BARE, DOI_HOST = "(https?://doi\\.org/[^\\s)）]+)", "\\b(10\\.\\d{4,9}/[^\\s)）]+)", "https://doi.org/"
STATUS_NAMES = {
    "资料齐全": "ready", "齐全": "ready", "缺pdf": "missing_pdf", "缺 pdf": "missing_pdf", "缺ppt": "missing_ppt", "缺 ppt": "missing_ppt", "只有笔记": "note_only",
}


def split_items(notes: DataFrame, key: str, text: str) -> DataFrame:
    """Notes as items: key, item_id, title, body.

    Lines that are numbered headings begin items; notes without any are split at plain headings, but for those that head no item.
    Items take their heading's number, or their place where the number is 0, or where numbers of a note repeat, or without
    numbers. Lines before the first heading belong to no item.
    """
    lines = notes.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    lines = lines.select(key, "at", "line", F.regexp_extract("line", NUMBERED, 1).alias("number"))
    whole = Window.partitionBy(key)
    numbered = F.max(F.when(F.col("number") != "", True)).over(whole).isNotNull()
    tidy = lambda c: F.trim(F.regexp_replace(c, "[*#\\\\]+", ""))
    plain = tidy(F.regexp_extract("line", HEADING, 1))
    title = F.when(numbered, tidy(F.regexp_extract("line", NUMBERED, 2))).when((F.length(plain) > 1) & ~plain.isin(*NO_TITLES), plain).otherwise("")
    begins = F.when(F.col("numbered"), F.col("number") != "").otherwise(F.col("title") != "")
    lines = lines.withColumn("numbered", numbered).withColumn("title", title).withColumn("begins", begins)
    lines = lines.withColumn("section", F.sum(F.col("begins").cast("int")).over(whole.orderBy("at"))).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("begins"), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    items = lines.groupBy(key, "section").agg(F.max(F.when(F.col("begins"), F.struct("title", "number"))).alias("h"), body.alias("body"))
    items = items.select(key, "section", "h.title", "h.number", F.trim(F.regexp_replace("body", "^\\s+|\\s+$", "")).alias("body"))
    items = items.where((F.col("title") != "") & (F.col("title") != SAMPLE_TITLE))
    place = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    number = F.coalesce(F.nullif(F.expr("try_cast(number as int)"), F.lit(0)), F.col("place"))
    items = items.withColumn("place", place).withColumn("own", number)
    repeats = F.size(F.collect_set("own").over(whole)) < F.count("*").over(whole)
    item = F.when(repeats, F.col("place")).otherwise(F.col("own"))
    return items.select(key, item_id(item.cast("string")).alias("item_id"), "title", "body")


def reader(body: Column) -> Column:
    """Who read an item, by the first form that its body has, or null."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(body, form, 1)), F.lit("")) for form in READERS])


def doi(body: Column) -> Column:
    """The link of an item: as it stands, or made from a bare DOI; or null."""
    bare = F.nullif(F.regexp_extract(body, DOI_BARE, 1), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(body, DOI_LINK, 1), F.lit("")), F.concat(F.lit(DOI_HOST), bare))


def keywords(title: Column, body: Column, words: list[str]) -> Column:
    """The words that the title or the first 500 letters of the body have, in the order of the list."""
    text = F.concat(title, F.lit("\n"), F.left(body, F.lit(500)))
    return F.array_join(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), ";")


def attachments(body: Column, suffixes: tuple[str, ...]) -> Column:
    """Names of attached files, those of links first, then those in plain text; each once, in order, without escapes."""
    kinds = "|".join(sorted((x.lstrip(".") for x in suffixes), key=len, reverse=True))
    linked = F.regexp_extract_all(body, F.lit(f"(?i)\\[([^\\]\\n\\r]+?\\\\?\\.(?:{kinds}))\\]\\([^)]*\\)"), 1)
    plain = F.regexp_extract_all(body, F.lit(f"(?i)([^\\n\\r\\[\\]]{{1,160}}?\\\\?\\.(?:{kinds}))"), 1)

    def clean(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(F.trim(x), "^[-*+\\s\\[(（]+", ""), "[\\])）\\s]+$", "")
        return F.trim(F.replace(F.replace(x, F.lit("%20"), F.lit(" ")), F.lit("\\"), F.lit("")))

    return F.filter(F.array_distinct(F.transform(F.concat(linked, plain), clean)), lambda x: x != "")


def status_of(name: str) -> str:
    """The status that a user's word for it means."""
    name = name.strip().lower()
    return STATUS_NAMES.get(name, name)


def lookup(rows: DataFrame, *, reader: str | None = None, status: str | None = None, item: str | None = None, missing: bool = False) -> DataFrame:
    """Rows of the catalog (item_id, reader, status) by part of the reader's name, by status, by id, or those with missing files."""
    if reader is not None:
        rows = rows.where(F.contains(F.col("reader"), F.lit(reader.strip())))
    if status is not None:
        rows = rows.where(F.col("status") == status_of(status))
    if item is not None:
        rows = rows.where(item_id(F.col("item_id")) == item_id(F.lit(item)))
    return (rows.where("status <> 'ready'") if missing else rows).orderBy("item_id")


def resolve_ids(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """The id of each new item: the one asked for, or that of its file in the catalog, or the next free number.

    asked: key, explicit, file; catalog: item_id, file. Items are resolved one by one, as each is added before the next is asked for.
    """
    by_file = catalog.where("file <> ''").groupBy("file").agg(F.min("item_id").alias("known"))
    free = catalog.agg((F.coalesce(F.max(F.expr("try_cast(item_id as bigint)")), F.lit(0)) + 1).alias("free"))  # one row
    joined = asked.join(by_file, "file", "left").crossJoin(F.broadcast(free))
    explicit = item_id(F.nullif(F.trim("explicit"), F.lit("")))
    free = F.col("free").cast("string")
    return joined.select("key", F.coalesce(explicit, "known", F.lpad(free, F.greatest(F.lit(3), F.length(free)), "0")).alias("item_id"))


def status(has_pdf: Column, has_ppt: Column) -> Column:
    return F.when(has_pdf & has_ppt, "ready").when(has_pdf, "missing_ppt").when(has_ppt, "missing_pdf").otherwise("note_only")


def override(rows: DataFrame, by: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-empty values of `by` win, column by column; `changed` says if any did."""
    o = by.select(key, *[F.nullif(c, F.lit("")).alias("o_" + c) for c in columns])
    joined = rows.join(o, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | F.coalesce(F.col("o_" + c).isNotNull(), F.lit(False))
    rest = [c for c in rows.columns if c not in columns]
    return joined.select(*rest, *[F.coalesce("o_" + c, c).alias(c) for c in columns], changed.alias("changed"))


def item_id(c: Column) -> Column:
    """Ids of digits only are padded to three places."""
    c = F.trim(c)
    return F.when(c.rlike("^[0-9]{1,2}$"), F.lpad(c, 3, "0")).otherwise(c)


def _anchors(c: Column, n: int) -> Column:
    """The distinct pieces of 1 to n letters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.transform(at, lambda i: F.substring(c, i, k)))))


def _containing(i: DataFrame, f: DataFrame, n: int = 8) -> DataFrame:
    """Pairs of distinct names n, fn of which one contains the other: the longer one has the first n letters of the shorter one."""

    def within(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        heads = short.select(s, F.substring(s, 1, n).alias("g"))
        return long.select(t, F.explode(_anchors(F.col(t), n)).alias("g")).join(heads, "g").where(F.contains(F.col(t), F.col(s))).select("n", "fn")

    return within(f, "fn", i, "n").unionByName(within(i, "n", f, "fn")).distinct()


#: Names of a block.
FUZZY_BLOCK = 2048


def _fuzzy(i: DataFrame, f: DataFrame, least: float) -> DataFrame:
    """n, fn, score: of each name n the most similar names fn, if `least` or more. i: n; f: fn; distinct and not empty.

    At 0.45 two names need not share even a pair of letters, so no key of a join keeps every match: all blocks of names
    are compared with all blocks of file names; within two blocks by a trie of the file names (names.py), which leaves branches that
    no name can be similar to, and shares the work on common heads.
    """
    item_blocks, file_blocks = [max(1, -(-d.count() // FUZZY_BLOCK)) for d in (i, f)]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = i.select(F.col("n").alias("x"), F.lit(False).alias("is_file"), block("n", item_blocks).alias("a"), every(file_blocks).alias("b"))
    right = f.select(F.col("fn").alias("x"), F.lit(True).alias("is_file"), every(item_blocks).alias("a"), block("fn", file_blocks).alias("b"))

    def compare(rows: pa.Table) -> pa.Table:
        sides: tuple[list[str], list[str]] = ([], [])
        for x, is_file in zip(rows.column("x").to_pylist(), rows.column("is_file").to_pylist()):
            sides[is_file].append(x)
        found = list(most_similar(*sides, least)) if all(sides) else []
        n, fn, score = zip(*found) if found else ((), (), ())
        return pa.table({"n": pa.array(n, pa.string()), "fn": pa.array(fn, pa.string()), "score": pa.array(score, pa.float64())})

    pairs = left.unionByName(right).groupBy("a", "b").applyInArrow(compare, "n string, fn string, score double")
    pairs = pairs.withColumn("score", F.round("score", 6))
    return pairs.join(pairs.groupBy("n").agg(F.max("score").alias("score")), ["n", "score"])


def match(items: DataFrame, files: DataFrame, least: float = 0.45) -> DataFrame:
    """item, file, rung, score: the best file of each item by the lowest rung that matches.

    items: item, name; files: file, file_name. Rungs: 1 equal names, 2 equal normalised names, 3 one contains the other, the file
    name being specific (eight letters, not generic), 4 the file name begins with the item's id, 5 one contains the other,
    6 similar: `least` or more. The score is 1 - Levenshtein distance / longer length, and binds rung 6 only.
    Rungs work on distinct names; of files with one name the smallest counts.
    """
    i = items.select("item", "name", X.normalized(F.col("name")).alias("n"))
    f = files.select("file", "file_name", X.normalized(F.col("file_name")).alias("fn"))
    named = f.where("fn <> ''").groupBy("fn").agg(F.min("file").alias("file"))
    similar = F.round(1 - F.levenshtein("n", "fn") / F.greatest(F.length("n"), F.length("fn")), 6)
    exact = i.join(f.groupBy("file_name").agg(F.min("file").alias("file")), F.col("name") == F.col("file_name"))
    exact = exact.select("item", "file", F.lit(1).alias("rung"), F.lit(1.0).alias("score"))
    equal = i.join(named, F.col("n") == F.col("fn")).select("item", "file", F.lit(2).alias("rung"), F.lit(1.0).alias("score"))
    specific = (F.length("fn") >= 8) & ~F.col("fn").isin(*GENERIC)
    names = i.where("n <> ''").select("n").distinct()
    held = _containing(names, named.select("fn")).join(named, "fn")
    held = held.select("n", "file", F.when(specific, 3).otherwise(5).alias("rung"), similar.alias("score"))
    held = _best_file(held, "n").join(i, "n").select("item", "file", "rung", "score")
    ids = i.select("item", "n", item_id(F.col("item").cast("string")).alias("id")).where("id <> ''")
    longest = ids.agg(F.max(F.length("id")).alias("longest"))
    starts = f.where("file_name <> ''").join(F.broadcast(longest))
    starts = starts.select("file", "fn", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("file_name"), F.col("longest"))), lambda k: F.substring("file_name", F.lit(1), k))).alias("id"))
    prefix = ids.join(starts, "id").select("item", "file", F.lit(4).alias("rung"), F.coalesce(similar, F.lit(0.0)).alias("score"))
    sure = _best_file(exact.unionByName(equal).unionByName(held).unionByName(prefix), "item")

    open_ = i.where("n <> ''").join(sure.select("item"), "item", "left_anti").select("item", "n")
    near = _fuzzy(open_.select("n").distinct(), named.select("fn"), least).join(named, "fn")
    near = _best_file(near.select("n", "file", F.lit(6).alias("rung"), "score"), "n")
    return sure.unionByName(open_.join(near, "n").select("item", "file", "rung", "score"))


def _best_file(rows: DataFrame, key: str) -> DataFrame:
    """Per key the row of the lowest rung, then the highest score, then the smallest file."""
    best = rows.groupBy(key).agg(F.min(F.struct("rung", (-F.col("score")).alias("m"), "file")).alias("e"))
    return best.select(key, "e.file", "e.rung", (-F.col("e.m")).alias("score"))


def fill_by_order(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str) -> DataFrame:
    """The i-th row without a match takes the i-th free one of its group."""
    a = running(left, [group], [F.col(left_key).asc()], rank="i")
    b = running(right, [group], [F.col(right_key).asc()], rank="i")
    return a.join(b.select(group, "i", right_key), [group, "i"], "left").drop("i")
