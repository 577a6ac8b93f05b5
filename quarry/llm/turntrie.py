"""The prefix trie of conversations, with the totals of its subtrees by an Euler tour.

A node is a distinct sequence of first turns (role and text). Every conversation gets the fingerprint of each of its prefixes as a
running sum of hashes of its turns and their places (four sums of 31 bits, hashed to 128 bits at the end), so that equal prefixes
meet by an aggregation and a prefix knows the one before it. Each node gives two arcs, into it and out of it. The tour goes from an
arc to the next one: into the first child, from a child out into the next one (children by their smallest member), from the last
child out of the parent, from a leaf in and out. `places` ranks this list: in each round the arcs whose hash is below those of both
neighbours leave it and their neighbours are joined up, until few are left; then the arcs come back in reverse order, each at its
known distance from its neighbour. Prefix sums at the arcs' places, taken on the way out less those on the way in, are the totals
of a node's subtree.

Ranks and running sums go by ranges (quarry.operators.ranks), so a conversation, a level or a node's children may be any share of
the rows. Where many rows meet one (turns their conversation, children their parent), the frequent ones are broadcast (graph.py).
The members that end at a node are hashed as a stream in their order, a packed piece of them at a time.

Defined results: rows without a conversation id are left out; a null turn comes first, turns of one number follow by role and text;
repeated rows are turns of their own; a null role or text is empty, so equal to an empty one; texts of any length count by their
hash; a table without rows has no node, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table
from quarry.llm.graph import spread_join
from quarry.llm.mixing import words
from quarry.operators.ranks import running

#: Turns that a rebuilt conversation takes from the first one of its group, at most, and the size of a group.
BORROWED, GROUP = 4, 20
#: A list of at most so many arcs is ranked by the driver.
SHORT_LIST = 1024
#: Members that end at one node are hashed in pieces of so many at most.
PIECE = 1 << 16
#: An arc's neighbours and the distances to them, and those that it gets in a round.
OLD, NEW = ("before", "after", "from", "to"), ("new_before", "new_after", "new_from", "new_to")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
BITS = (1 << 31) - 1


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), a and b (128 bits of role and text) and words of every turn, in order."""
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(turn).alias("t"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(n) for x, n in ((role, "r"), (text, "x"))])
    kept = ["c", F.xxhash64("r", "x").alias("a"), F.xxhash64(F.lit(7), "x", "r").alias("b"), words(F.col("x")).alias("words")]
    return running(rows, ["c"], [F.col("t").asc_nulls_first(), F.col("r").asc(), F.col("x").asc()], rank="pos", keep=kept)


def rebuilt(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) after the first turns of each conversation have been replaced by those of its group's first one.

    rows: c, pos, a, b, words, turns (number of the conversation's turns). conversations: c, turns.
    """
    own = turned.groupBy("c").agg(F.count("*").alias("had"))
    borrowed = (F.crc32(F.col("c").cast("string").cast("binary")) % BORROWED).cast("int")
    head = turned.where((F.col("pos") < BORROWED) & (F.col("c") % GROUP == 0)).groupBy("c")
    head = head.agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))  # three turns at most
    convs = own.withColumns({"first": F.col("c") - F.col("c") % GROUP, "h": borrowed}).join(head.withColumnRenamed("c", "first"), "first", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h")))
    convs = convs.select("c", "had", "h", "head", (F.size("head") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).cast("long").alias("turns"))
    convs = stored(convs, "convs")
    moved = convs.select("c", "had", "h", "turns", (F.col("h") - F.size("head")).alias("back"))
    total = int(convs.agg(F.sum("had")).first()[0] or 0)
    rows = spread_join(turned, moved, "c", "had", total).where("pos > h")
    rows = rows.select("c", (F.col("pos") - F.col("back")).alias("pos"), "a", "b", "words", "turns")
    taken = convs.select("c", F.explode("head").alias("t"), "turns").select("c", "t.pos", "t.a", "t.b", "t.words", "turns")
    return rows.unionByName(taken), convs.select("c", "turns")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.struct(depth.cast("long").alias("d"), F.xxhash64(*sums).alias("f"), F.xxhash64(F.lit(7), *reversed(sums)).alias("g"))


def prefixes(rows: DataFrame) -> DataFrame:
    """c, key (of the prefix that ends with the row's turn), parent (key of the prefix before it), words, last."""
    one, two = F.xxhash64("pos", "a", "b"), F.xxhash64("b", "a", "pos")
    parts = [one.bitwiseAND(BITS), F.shiftrightunsigned(one, 33), two.bitwiseAND(BITS), F.shiftrightunsigned(two, 33)]
    rows = rows.select("c", "pos", "words", (F.col("pos") == F.col("turns")).alias("last"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    summed = running(rows, ["c"], [F.col("pos").asc()], rank="_", sums={f"s{i}": f"p{i}" for i in range(4)})
    upto, before = [F.col(f"s{i}") for i in range(4)], [F.col(f"s{i}") - F.col(f"p{i}") for i in range(4)]
    return summed.select("c", _key(F.col("pos"), upto).alias("key"), _key(F.col("pos") - 1, before).alias("parent"), "words", "last")


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0).cast("long")] * 4)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of key, c in order become pieces of key, seq and the decimal ids of a run of one key, comma-joined."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, c = batch.column(0), batch.column(1).to_numpy()
        parts = [key.field(i).to_numpy() for i in range(3)]
        differs = np.zeros(len(c) - 1, bool)
        for p in parts:
            differs |= p[1:] != p[:-1]
        edges = np.concatenate([[0], np.flatnonzero(differs) + 1, [len(c)]])
        spans = [(a, min(b, a + PIECE)) for s, b in zip(edges[:-1], edges[1:]) for a in range(s, b, PIECE)]
        starts = np.array([a for a, _ in spans])
        seq = (task << 33) + number + np.arange(len(spans))
        number += len(spans)
        pieces = pa.array([",".join(map(str, c[a:b].tolist())).encode() for a, b in spans], pa.binary())
        yield pa.RecordBatch.from_arrays([key.take(pa.array(starts)), pa.array(seq, pa.int64()), pieces], names=["key", "seq", "ids"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and seq become one SHA-256 a key; a key's pieces are never held together."""
    now, state = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if key != now:
                if now is not None:
                    keys.append(now)
                    digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.as_buffer())
            else:
                state.update(b",")
                state.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(digests, pa.string())], names=["key", "sha"])
        kind = batch.column(0).type
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names=["key", "sha"])


KEY = "key struct<d:bigint,f:bigint,g:bigint>"


def digests(ends: DataFrame) -> DataFrame:
    """ends: key, c. key and sha of the ids that end there, ascending."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "c"]
    packed = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack, f"{KEY}, seq long, ids binary")
    packed = stored(packed, "ends")
    return packed.repartition(parts, "key").sortWithinPartitions("key", "seq").mapInArrow(_hash, f"{KEY}, sha string")


def tour(nodes: DataFrame) -> DataFrame:
    """id, before, after of every arc: 2 x node into it, 2 x node + 1 out of it. The first arc has no arc before it, the last none after.

    nodes: node, nth (among its parent's children), parent_node (null at the root), n_siblings, n_children.
    """
    into, out = F.col("node") * 2, F.col("node") * 2 + 1
    leaf = nodes.where("n_children = 0").select(into.alias("x"), out.alias("y"))
    first = nodes.where("nth = 1 and parent_node is not null").select((F.col("parent_node") * 2).alias("x"), into.alias("y"))
    last = nodes.where("nth = n_siblings and parent_node is not null").select(out.alias("x"), (F.col("parent_node") * 2 + 1).alias("y"))
    following = nodes.select("parent_node", (F.col("nth") - 1).alias("nth"), into.alias("y"))
    across = nodes.select("parent_node", "nth", out.alias("x")).join(following, ["parent_node", "nth"]).select("x", "y")
    steps = leaf.unionByName(first).unionByName(last).unionByName(across)
    none = F.lit(None).cast("long")
    both = steps.select(F.col("x").alias("id"), none.alias("before"), F.col("y").alias("after")).unionByName(steps.select(F.col("y").alias("id"), F.col("x").alias("before"), none.alias("after")))
    return both.groupBy("id").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def places(arcs: DataFrame, short: int = SHORT_LIST) -> DataFrame:
    """id and place (from 0) of every arc of one list. arcs: id, before, after.

    An arc leaves in a round if its hash is below those of both neighbours, which is so for a third of them; no two neighbours leave
    together. Its neighbours get each other, and the distance. A round is one aggregation in which no arc gets more than three rows,
    and a third smaller than the one before, so all rounds together move some three times the list. Coming back, an arc stands at the
    place of the one before it plus the distance. Rounds are written out.
    """
    spark = arcs.sparkSession
    now = stored(arcs.select("id", "before", "after", F.lit(1).cast("long").alias("from"), F.lit(1).cast("long").alias("to")), "arcs")
    rounds = []
    while now.count() > short:
        seed = F.lit(len(rounds))
        leaves = (F.xxhash64("id", seed) < F.xxhash64("before", seed)) & (F.xxhash64("id", seed) < F.xxhash64("after", seed)) & F.col("before").isNotNull() & F.col("after").isNotNull()
        rounds.append(now.where(leaves).select("id", "before", "from"))
        none, gap = F.lit(None).cast("long"), F.col("from") + F.col("to")
        stay = now.where(~leaves).select("*", *[none.alias(c) for c in NEW])
        to_before = F.struct(F.col("before").alias("id"), none.alias(NEW[0]), F.col("after").alias(NEW[1]), none.alias(NEW[2]), gap.alias(NEW[3]))
        to_after = F.struct(F.col("after").alias("id"), F.col("before").alias(NEW[0]), none.alias(NEW[1]), gap.alias(NEW[2]), none.alias(NEW[3]))
        told = now.where(leaves).select(F.explode(F.array(to_before, to_after)).alias("m")).select("m.id", *[none.alias(c) for c in OLD], *[f"m.{c}" for c in NEW])
        joined = stay.unionByName(told).groupBy("id").agg(*[F.coalesce(F.max(new), F.max(old)).alias(old) for old, new in zip(OLD, NEW)])
        now = stored(joined, "arcs")
    left = {r["id"]: r for r in now.collect()}  # `short` rows at most
    at = next((i for i, r in left.items() if r["before"] is None), None)
    found, place = [], 0
    while at is not None:
        found.append((at, place))
        place += left[at]["to"]
        at = left[at]["after"]
    known = spark.createDataFrame(found, "id long, place long")
    for gone in reversed(rounds):
        back = gone.join(known.select(F.col("id").alias("before"), "place"), "before").select("id", (F.col("place") + F.col("from")).alias("place"))
        known = stored(known.unionByName(back), "places")
    return known


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: c, pos, a, b, words, turns; convs: c, turns, as of rebuilt().
    """
    found = stored(prefixes(rows), "prefixes")
    nodes = found.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("parent.f").alias("f"), F.max("parent.g").alias("g"), F.max("words").alias("words"))
    nodes = nodes.select("key", "n_convs", "conv_id", F.struct((F.col("key.d") - 1).alias("d"), "f", "g").alias("parent"), "words")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    none = F.lit(None)
    root = root.select(root_key().alias("key"), "n_convs", "conv_id", none.cast(found.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("words"))
    nodes = running(nodes.unionByName(root), ["parent"], [F.col("conv_id").asc()], rank="nth", unique="node")
    nodes = stored(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    parents = stored(nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").na.fill(0, ["n"]), "parents")
    number = nodes.count()
    upper = parents.where("n > 0").select(F.col("key").alias("parent"), F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_siblings"), F.col("n").alias("size"))
    hung = spread_join(parents.where("parent is not null"), upper, "parent", "size", number)
    top = parents.where("parent is null").select("*", *[none.cast("long").alias(c) for c in ("parent_node", "parent_conv_id", "n_siblings")])
    hung = stored(hung.unionByName(top).withColumnRenamed("n", "n_children"), "hung")
    placed = places(tour(hung)).select(F.shiftright("id", 1).alias("node"), F.col("id").bitwiseAND(1).alias("out"), "place")
    weight = hung.select("node", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    entered = placed.join(weight, "node").select("node", "out", "place", *[F.when(F.col("out") == 0, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")])
    sums = running(entered, [], [F.col("place").asc()], rank="_", sums={"leaves": "leaf", "saves": "saved"})
    side = lambda c, out: F.max(F.when(F.col("out") == out, F.col(c)))
    totals = sums.groupBy("node").agg(*[(side(s, 1) - side(s, 0) + F.max(w)).alias(name) for s, w, name in (("leaves", "leaf", "n_leaves"), ("saves", "saved", "saved_tokens"))])
    ends = found.where("last").select("key", "c").unionByName(convs.where("turns = 0").select(root_key().alias("key"), "c"))
    out = hung.join(totals, "node").join(digests(ends), "key", "left")
    return out.select("key", "conv_id", F.col("key.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op11_turntrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    rows, convs = rebuilt(turns(table(spark, sf_dir, "conversations")))
    return trie(stored(rows, "rebuilt"), convs).drop("key")


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY c),
k AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS crc),
h AS (SELECT c, own, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) % 4 AS h FROM o, k),
r AS (SELECT h.c, list_concat(coalesce(g.own[1:h.h], []), h.own[h.h + 1:]) AS s FROM h LEFT JOIN o g ON g.c = h.c - h.c % 20),
p AS (SELECT c, d, s[1:d] AS key, s[1:d - 1] AS parent, len(s) = d AS ended, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM r, unnest(range(0, len(s) + 1)) AS x(d)),
n AS (SELECT d, key, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends FROM p GROUP BY d, key),
b AS (SELECT d, parent, count(*) AS n FROM n WHERE d > 0 GROUP BY d, parent),
m AS (SELECT n.*, coalesce(b.n, 0) AS n_children, u.conv_id AS up FROM n LEFT JOIN b ON b.d = n.d + 1 AND b.parent = n.key LEFT JOIN n u ON u.d = n.d - 1 AND u.key = n.parent),
z AS (SELECT y.d, y.key, count(*) FILTER (x.n_children = 0) AS leaves, sum((x.n_convs - 1) * x.words) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS dd FROM m) x JOIN m y ON y.d = x.dd AND y.key = x.key[1:x.dd] GROUP BY y.d, y.key)
SELECT conv_id, m.d::BIGINT AS depth, up AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256 FROM m JOIN z ON z.d = m.d AND z.key = m.key
"""
