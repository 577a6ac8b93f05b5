"""Near-duplicate detection with a MinHash LSH forest; links are confirmed on full shingle sets.

1. Every document becomes its set of distinct word shingles, hashed to 64 bits, a 128-bit key of the whole set and a label
   of DEPTH minima for each tree. Documents with equal sets are one class. Classes are numbered in the order of their smallest
   doc_ids, so the smallest class of a component has its smallest doc_id.
2. The forest: for each tree the classes are sorted by label over the whole cluster (a range partitioning by tree, label and
   id, so that no label, however frequent, has to fit a task). Classes whose labels share their first BASE minima form a
   region; a region of more than REGION classes is split by the next minimum, down to DEPTH. A region's members are joined to
   its first one, and regions cut by a partition border are joined across it.
   Two sets of similarity 0.85 share all DEPTH minima of a tree with probability 0.27, and of at least one of 32 trees with
   0.99996; at similarity 0.8 it is 0.17, and 0.99999 with 64 trees. `trees_for` gives the number of trees for a limit; nothing
   else decides which pairs are looked at.
3. Connected components of these joints are clusters of candidates. A cluster is dealt into blocks of at most BLOCK classes, and
   of about BLOCK_SHINGLES shingles. Inside a block all pairs of different components are compared: pairs of sizes that exclude a
   link, and pairs whose minima agree in so few places that a link is five standard deviations away (which overlooks one link at
   the limit in 10^5 at most, less than the forest does), drop out; all others are confirmed on the full sets.
4. A cluster of several blocks is finished without comparing all blocks with each other: each block is compared with the first
   one, which joins nearly everything that belongs together; then the classes still outside the cluster's largest component
   are compared with all blocks. Pairs inside one component need no comparison, so no link that matters is left out. (Where the
   forest joins very many documents that are not linked after all, this is all pairs of the cluster's blocks.)

Tasks are dealt by text bytes: small clusters share work items of about ITEM_BYTES. Joins of rows with their cluster or class
broadcast the few frequent ones (`graph.py`), so a group that holds a third of all rows does not land in one task.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and kept; texts with fewer words than a
shingle are one shingle; very long texts count whole; a null doc_id takes no part and gives a null component_id, kept; rows that
repeat a doc_id are documents of their own: each is linked by its own text, has the component of that text, and is kept if no
smaller doc_id is in it (so rows of one doc_id never make each other go); an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored, table
from quarry.llm.graph import components, spread_join
from quarry.llm.repeats import buckets, mix, named
from quarry.operators.ranks import running

DEPTH = 8
BASE = 6
REGION = 32
BLOCK = 64
BLOCK_SHINGLES = 1 << 21
ITEM_BYTES = 8 << 20
#: The contract's similarity: 100 * intersection >= 85 * union.
SIMILAR = (85, 100)
#: A pair at the limit is overlooked by the whole forest with this probability at most.
OVERLOOKED = 5e-5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def trees_for(similar: tuple[int, int]) -> int:
    """Trees, in steps of 32, that overlook a pair at the limit with probability OVERLOOKED at most."""
    missed, trees = 1 - (similar[0] / similar[1]) ** DEPTH, 32
    while missed**trees > OVERLOOKED:
        trees += 32
    return trees


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


def shingles(body: bytes | None, names: _Names, width: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text."""
    words = body.translate(_LOWER).split() if body else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    x = np.fromiter(map(names.__getitem__, words), dtype=np.uint64, count=len(words))
    out = x[: max(1, len(x) - width + 1)]
    for i in range(1, min(width, len(x))):
        out = named(out, x[i : i + len(out)], 10 * min(width, len(x)) + i)
    return np.unique(out)


def minima(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """The trees * DEPTH minima of each set, 16 bits of each. Sets are not empty."""
    factors = (mix(np.arange(trees * DEPTH, dtype=np.uint64), 9) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.zeros((len(sets), trees * DEPTH), dtype=np.uint16)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (total == 0 or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k, factor in enumerate(factors):
            least = np.minimum.reduceat(x * factor, starts)
            out[at:end, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        at = end
    return out


def _sketches(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """docs: id, print, body. id, print, n (size of the set), key (of the set) and labels (its minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in slices(batches, "body"):
            sets = [shingles(b, names, width) for b in batch.column("body").to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            labels: list = [None] * len(sets)
            for i, row in zip(some, minima([sets[i] for i in some], trees)):
                labels[i] = row.astype(">u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("print"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(labels, pa.binary()),
                ],
                names=["id", "print", "n", "key", "labels"],
            )

    return docs.mapInArrow(run, "id long, print long, n long, key binary, labels binary")


def _forest(classes: DataFrame, count: int) -> DataFrame:
    """classes: id, labels. Joints a, b between classes that share a region of some tree."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            labels = b"".join(batch.column("labels").to_pylist())
            size = 2 * DEPTH
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(count, dtype=np.int32), n)),
                    pa.array([labels[i : i + size] for i in range(0, len(labels), size)], pa.binary()),
                    pa.array(np.repeat(batch.column("id").to_numpy(), count)),
                ],
                names=["tree", "label", "id"],
            )

    trees = classes.mapInArrow(grow, "tree int, label binary, id long")
    n = buckets(classes)
    ordered = trees.repartitionByRange(n, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    joints = stored(ordered.mapInArrow(_neighbours, "a long, b long, part int, at int, tree int, label binary"), "joints")
    # the last class of a partition and the first of the next one, two rows a partition
    borders = joints.where("part is not null")
    order = Window.orderBy("part", "at")
    borders = borders.select("tree", "label", "a", *[F.lag(c).over(order).alias("p_" + c) for c in ("tree", "label", "a")])
    prefix = lambda c: F.substring(c, 1, 2 * BASE)
    across = borders.where((F.col("tree") == F.col("p_tree")) & (prefix("label") == prefix("p_label")))
    return joints.where("part is null").select("a", "b").unionByName(across.select("p_a", "a").toDF("a", "b"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition. Joints (a, b), and the first and the last row of the partition (part, at, tree, label, a)."""
    region: list[tuple[bytes, int]] = []
    now: tuple | None = None
    first = last = None

    def joints(rows: list[tuple[bytes, int]], depth: int) -> Iterator[tuple[int, int]]:
        if len(rows) <= REGION or depth == DEPTH:
            for _, other in rows[1:]:
                yield rows[0][1], other
            return
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0][: 2 * depth + 2] != rows[at][0][: 2 * depth + 2]:
                yield from joints(rows[at:i], depth + 1)
                at = i

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        none = pa.nulls(len(pairs), pa.int32())
        a, b = zip(*pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, none, pa.nulls(len(pairs), pa.binary())],
            names=["a", "b", "part", "at", "tree", "label"],
        )

    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in zip(batch.column("tree").to_pylist(), batch.column("label").to_pylist(), batch.column("id").to_pylist()):
            tree, label, number = row
            key = tree, label[: 2 * BASE]
            if key != now:
                if len(region) > 1:
                    found += joints(region, BASE)
                region, now = [], key
            region.append((label, number))
            first, last = first or row, row
        if found:
            yield out(found)
    if len(region) > 1:
        yield out(list(joints(region, BASE)))
    if first is not None:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([first[2], last[2]], pa.int64()),
                pa.nulls(2, pa.int64()),
                pa.array([part, part], pa.int32()),
                pa.array([0, 1], pa.int32()),
                pa.array([first[0], last[0]], pa.int32()),
                pa.array([first[1], last[1]], pa.binary()),
            ],
            names=["a", "b", "part", "at", "tree", "label"],
        )


class Side:
    """Some classes with their sets, their minima and the component each is in so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], trees: int, roots: list[int] | None = None):
        self.ids, self.sets = np.array(ids, dtype=np.int64), sets
        self.sizes = np.array([len(s) for s in sets])
        self.minima = minima(sets, trees)
        self.roots = np.array(roots if roots is not None else ids, dtype=np.int64)


def _linked(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return similar[1] * both >= similar[0] * (len(a) + len(b) - both)


def confirm(left: Side, right: Side, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Joins components of the two sides (which may be one) by confirmed links, and returns the joined roots."""
    limit = similar[0] / similar[1]
    places = left.minima.shape[1]
    enough = places * (limit - 5 * (limit * (1 - limit) / places) ** 0.5)
    found = []
    for i in range(len(left.ids)):
        after = i + 1 if left is right else 0
        sizes = right.sizes[after:]
        near = (right.roots[after:] != left.roots[i]) & (sizes >= limit * left.sizes[i]) & (limit * sizes <= left.sizes[i])
        at = np.flatnonzero(near) + after
        if not len(at):
            continue
        agree = (right.minima[at] == left.minima[i]).sum(axis=1)
        order = np.argsort(-agree, kind="stable")
        for j in at[order][agree[order] >= enough]:
            a, b = left.roots[i], right.roots[j]
            if a != b and _linked(left.sets[i], right.sets[j], similar):
                low, high = min(a, b), max(a, b)
                for side in {id(left): left, id(right): right}.values():
                    side.roots[side.roots == high] = low
                found.append((int(low), int(high)))
    return found


def _verify(work: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """work: item, side, id, root, body. Per item the two sides are compared (side 0 with itself if there is no other)."""

    def run(rows: pa.Table) -> pa.Table:
        names, links, trees = _Names(), [], trees_for(similar)
        data = rows.select(["pair", "side", "id", "root", "body"]).to_pylist()
        pairs: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in data:
            pairs.setdefault(r["pair"], {}).setdefault(r["side"], {})[r["id"]] = (shingles(r["body"], names, width), r["root"])
        for sides in pairs.values():
            made = {}
            for side, members in sides.items():
                ids = sorted(members)
                made[side] = Side(ids, [members[i][0] for i in ids], trees, [members[i][1] for i in ids])
            if 0 in made:
                found = confirm(made[0], made.get(1, made[0]), similar)
                # within one block a class hangs under its root; between two blocks roots are joined
                links += found if 1 in made else [(int(r), int(i)) for i, r in zip(made[0].ids, made[0].roots) if i != r]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work.groupBy("item").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similar: tuple[int, int] = SIMILAR, text_hash: str | None = None
) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (smallest id reachable over links) and kept (id_col = component_id).

    Texts are linked if their shingles of `width` words have similar[1] * intersection >= similar[0] * union.
    text_hash: name of a further column with hash_of() of the row's text, which tells rows of one id apart.
    """
    n, trees = buckets(docs), trees_for(similar)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), hash_of(F.col(text_col)).alias("print"), F.col(text_col).cast("binary").alias("body"))
    sketches = stored(_sketches(rows, width, trees), "sketches")
    sets = sketches.where("id is not null and key is not null")
    reps = sets.groupBy("key").agg(F.min("id").alias("rep"), F.min_by("print", F.struct("id", "print")).alias("print"), F.max("n").alias("n"), F.count("*").alias("rows"))
    reps = stored(running(reps, [], [F.col("rep").asc(), F.col("key").asc()], rank="node"), "classes")
    # joins of whole texts or labels with lists of ids are shuffles at every size
    wanted = reps.select(F.col("rep").alias("id"), "print", "node").hint("shuffle_hash")
    classes = sets.join(wanted, ["id", "print"]).select(F.col("node").alias("id"), "labels").dropDuplicates(["id"])

    clusters = components(_forest(classes, trees))
    clusters = clusters.join(reps.select(F.col("node").alias("id"), "n", "rep", "print").hint("shuffle_hash"), "id")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    members = spread_join(clusters, sizes.select("root", blocks.alias("blocks"), "size"), "root", "size", sketches.count())
    members = members.select("id", "rep", "print", F.col("root").alias("cluster"), "blocks")
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")))
    texts = rows.where("id is not null").withColumnRenamed("id", "rep").join(members.hint("shuffle_hash"), ["rep", "print"]).dropDuplicates(["id"])
    texts = stored(texts.select("id", "cluster", "blocks", "block", "body", F.octet_length("body").cast("long").alias("bytes")), "members")

    # small clusters share items; a block of a large cluster is an item of its own
    items = max(4 * n, -(-(texts.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0) // ITEM_BYTES))
    small = F.pmod(F.xxhash64(F.lit(5), "cluster"), F.lit(items))
    own = F.xxhash64("cluster", "block")
    item = F.when(F.col("blocks") == 1, small).otherwise(own)
    inside = texts.select(item.alias("item"), F.xxhash64("cluster", "block").alias("pair"), F.lit(0).alias("side"), "id", F.col("id").alias("root"), "body")
    stars = stored(_verify(inside, width, similar), "stars")
    roots = stars.select(F.col("b").alias("id"), F.col("a").alias("root"))
    large = texts.where("blocks > 1")
    if large.limit(1).count():  # else every cluster is one block, and its stars are its components
        links = _finish(large, roots, width, similar)
        moved = components(links).select(F.col("id").alias("old"), F.col("root").alias("new"))
        ids = links.select(F.explode(F.array("a", "b")).alias("id")).unionByName(roots.select("id")).distinct()
        roots = ids.join(roots, "id", "left")
        roots = roots.withColumn("old", F.coalesce("root", "id")).join(moved, "old", "left").select("id", F.coalesce("new", "old").alias("root"))
    more = [F.col("print").alias(text_hash)] if text_hash else []
    return _labels(sketches, reps, roots).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *more
    )


def hash_of(text: Column) -> Column:
    """Tells texts of one id apart; a null text has a hash of its own."""
    return F.xxhash64(text.cast("binary"), text.isNull())


def _finish(large: DataFrame, roots: DataFrame, width: int, similar: tuple[int, int]) -> DataFrame:
    """Links a, b between roots of clusters of several blocks: each block against the first, then what is left against all."""

    def compare(left: DataFrame, right: DataFrame) -> DataFrame:
        """left and right: cluster and pair, chosen so that a pair is one block of each side."""
        both = left.unionByName(right)
        both = both.withColumn("item", F.xxhash64("cluster", "pair")).withColumn("pair", F.col("item"))
        return _verify(both.select("item", "pair", "side", "id", "root", "body"), width, similar)

    now = stored(large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    others = now.where("block > 0").select("cluster", F.col("block").alias("pair"), F.lit(0).alias("side"), "id", "root", "body")
    first = now.where("block = 0").withColumn("pair", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    first = first.select("cluster", "pair", F.lit(1).alias("side"), "id", "root", "body")
    links = stored(compare(others, first), "links")

    # a step towards components is enough here: it only saves comparisons
    ends = links.select(F.col("b").alias("root"), F.col("a").alias("to"))
    nearer = ends.groupBy("root").agg(F.min("to").alias("to"))
    now = now.join(nearer, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
    now = stored(now, "rooted")
    sizes = now.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("size", "root")).alias("m")).select("cluster", F.col("m.root").alias("main"))
    outside = stored(now.join(main, "cluster").where("root <> main").drop("main"), "outside")
    groups = outside.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("groups"))
    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("groups"))
    left = outside.join(groups, "cluster").withColumn("part", part)
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = lambda a, b: F.xxhash64(a, b)
    left = left.select("cluster", pair("part", "other").alias("pair"), F.lit(0).alias("side"), "id", "root", "body")
    right = now.join(groups, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    right = right.select("cluster", pair("part", "block").alias("pair"), F.lit(1).alias("side"), "id", "root", "body")
    return links.unionByName(stored(compare(left, right), "links"))


def _labels(sketches: DataFrame, reps: DataFrame, roots: DataFrame) -> DataFrame:
    """sketches with component_id: the smallest id of the classes that have the class's root, or the row's own id."""
    known = reps.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = stored(known.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "roots")
    known = stored(spread_join(known.select("key", "root", "rows"), per_root, "root", "size", reps.count()).select("key", "component_id", "rows"), "known")
    part = sketches.select("id", "print", "n", "key")
    inside = F.col("id").isNotNull() & F.col("key").isNotNull()
    with_class = spread_join(part.where(inside), known, "key", "rows", sketches.count()).select("id", "print", "n", "component_id")
    return with_class.unionByName(part.where(~inside).select("id", "print", "n", F.col("id").alias("component_id")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) >= 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.b) AS component_id, d.doc_id = min(c.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id GROUP BY d.doc_id, n.n
"""
