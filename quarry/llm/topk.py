"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are integers, floor(64 * x). Candidates are dealt out by ranges of vec_id and packed into document-range blocks, each
with the maximum and the minimum of every term. For a query the bound of a block is the sum of its terms' largest possible
contributions; each query visits blocks in its own order, from the highest bound down (one, then two, four, ... at a time), and
scores them through their forward index (the block's matrix) until the bound falls below its kth best score.

The lowest ids, HOME of them or a few more, are searched first. They give every query a kth best (score, id), which all later
candidates have to beat: an equal score does not, as their ids are higher. So equal vectors cost nothing after the first pass.
The other ranges are searched in chains: a block of queries goes along the ranges of a chain with the k best it has so far, and
k rows at most leave a chain. Query blocks meet chains by an equi-join on the chain, so no task holds more than HELD blocks of
queries and the packed ranges of one chain, and nothing but counts reaches the driver. Every query has to be judged against
every block by its bound: work grows as queries x vectors where bounds do not prune.

Defined results: a vector that is null, holds a null or a non-finite component, or has a null id takes no part; shorter
vectors count as padded with zeros; exactly repeated rows count once; rows that repeat an id with another vector are candidates
of their own, and queries that repeat an id are asked as one; ties go to the smaller vec_id. Components beyond 64 bits are cut
to the nearest 64-bit integer, and so are scores (which are added up exactly before). An empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

K = 20
SCALE = 64
CANDIDATES = 8192  # rows in one packed range
HOME = 8192  # rows that are searched first
QUERIES = 256  # rows in one packed block of queries
BLOCK = 128  # rows in one block with its own bounds
HELD = 256  # blocks of queries that a task has under way
CHAIN = 64  # packed ranges that a block of queries visits in one go, at most

_PACKED = "part int, at int, rows int, ids binary, width int, kind string, matrix binary"
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integers(vector: Column) -> Column:
    """floor(64 * x) of every component, or null if the vector takes no part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ints = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~F.exists(vector, odd), ints)


def _pack(size: int):
    """Rows (id, vector) of a partition, sorted by id, as packed blocks of `size` rows; exact repeats are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        seen: set[bytes] = set()
        at = 0
        for batch in batches:
            lists = batch.column("vector")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for i, vec_id in enumerate(batch.column("id").to_pylist()):
                row = values[ends[i] : ends[i + 1]]
                if not ids or ids[-1] != vec_id:
                    seen = set()
                if (mark := row.tobytes()) in seen:
                    continue
                if len(ids) == size:
                    yield _packed(ids, rows, at)
                    ids, rows, at = [], [], at + 1
                seen.add(mark)
                ids.append(vec_id)
                rows.append(row)
        if ids:
            yield _packed(ids, rows, at)

    return run


def _largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python integer: that of the smallest 64-bit integer is none of 64 bits."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _packed(ids: list[int], rows: list[np.ndarray], at: int) -> pa.RecordBatch:
    width = max(map(len, rows))
    matrix = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        matrix[i, : len(row)] = row
    kind = "<i2" if _largest(matrix) < 1 << 15 else "<i8"
    return pa.RecordBatch.from_pylist(
        [
            {
                "part": TaskContext.get().partitionId(),
                "at": at,
                "rows": len(ids),
                "ids": np.asarray(ids, dtype="<i8").tobytes(),
                "width": width,
                "kind": kind,
                "matrix": matrix.astype(kind).tobytes(),
            }
        ],
        schema=pa.schema(
            [("part", pa.int32()), ("at", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary())]
        ),
    )


def _matrix(row: dict, side: str) -> np.ndarray:
    return np.frombuffer(row[side + "matrix"], dtype=row[side + "kind"]).reshape(row[side + "rows"], row[side + "width"]).astype(np.int64)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


class BlockTopK:
    """The k best candidates so far of each query, by (score descending, id ascending)."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None):
        """best: a score and an id for each query that a candidate has to beat."""
        self.queries, self.own, self.k = queries, own, k
        self.score, self.id = np.full((len(own), k), _LOW), np.full((len(own), k), _HIGH)
        self.count = np.zeros(len(own), dtype=np.int64)  # filled places
        self.least, self.least_id = np.full(len(own), _LOW), np.full(len(own), _HIGH)
        self.open = np.ones(len(own), dtype=bool)  # any score will do
        if best is not None:
            self.least, self.least_id = best[0].copy(), best[1].copy()
            self.open = (self.least == _LOW) & (self.least_id == _HIGH)

    def visit(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes the scores of a block for the queries numbered `at`."""
        least = self.least[at, None]
        near = (scores > least) | ((scores == least) & (ids[None, :] < self.least_id[at, None])) | self.open[at, None]
        near &= ids[None, :] != self.own[at, None]
        for i in np.flatnonzero(near.any(axis=1)):
            n, better = at[i], near[i]
            have = self.count[n]
            s = np.concatenate([self.score[n, :have], scores[i, better]])
            v = np.concatenate([self.id[n, :have], ids[better]])
            order = np.lexsort((v, ~s))[: self.k]  # ~s falls as s rises, and cannot overflow
            self.count[n] = now = len(order)
            self.score[n, :now], self.id[n, :now] = s[order], v[order]
            if now == self.k:
                self.least[n], self.least_id[n], self.open[n] = s[order[-1]], v[order[-1]], False

    def search(self, candidates: np.ndarray, ids: np.ndarray) -> None:
        """Every query visits the blocks of a range in its own order, as long as their bounds reach its kth best."""
        width = max(self.queries.shape[1], candidates.shape[1])
        queries, candidates = _wide(self.queries, width), _wide(candidates, width)
        starts = np.arange(0, len(ids), BLOCK)
        top, low = np.maximum.reduceat(candidates, starts, axis=0), np.minimum.reduceat(candidates, starts, axis=0)
        smallest_id = np.minimum.reduceat(ids, starts)
        most = max(1, _largest(queries)) * max(1, _largest(candidates)) * max(1, width)
        # doubles hold every sum, or 64-bit integers do, or only Python's integers
        kind = np.float64 if most < 1 << 52 else np.int64 if most < 1 << 63 else object
        q, x = queries.astype(kind), candidates.astype(kind)
        exact = lambda s: (np.clip(s, _LOW, _HIGH) if kind is object else s).astype(np.int64)
        bound = exact(np.maximum(q, 0) @ top.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind))
        order = np.argsort(~bound, axis=1, kind="stable")
        going, turn, step = np.arange(len(self.own)), 0, 1
        while turn < len(starts) and len(going):
            ahead = order[going, turn : turn + step]  # the next blocks of every query: one, then two, four, ...
            for block in np.unique(ahead):
                at = going[(ahead == block).any(axis=1)]
                reach, least = bound[at, block], self.least[at]
                at = at[(reach > least) | ((reach == least) & (smallest_id[block] < self.least_id[at])) | self.open[at]]
                if len(at):
                    part = slice(starts[block], starts[block] + BLOCK)
                    self.visit(at, exact(q[at] @ x[part].T), ids[part])
            turn, step = turn + step, 2 * step
            if turn < len(starts):  # all later bounds of a query are lower: once below its kth score, it is done
                going = going[(bound[going, order[going, turn]] >= self.least[going]) | self.open[going]]


def _search(k: int):
    """Rows with a packed range of candidates and a packed block of queries: q_block and the k best of each of its queries (count of
    each, scores and ids, packed) over the rows of a task. HELD blocks are kept at a time; a block that comes again later is
    answered again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, BlockTopK] = {}

        def answer(block: int) -> pa.RecordBatch:
            found = held.pop(block)
            packed = [[x.astype("<i8").tobytes()] for x in (found.own, found.count, found.score, found.id)]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], names=["q_block", "own", "count", "score", "id"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = row["q_block"]
                if block not in held:
                    if len(held) == HELD:
                        yield answer(next(iter(held)))
                    own = np.frombuffer(row["q_ids"], dtype="<i8")
                    best = None
                    if row["q_least"] is not None:
                        best = np.frombuffer(row["q_least"], dtype="<i8"), np.frombuffer(row["q_least_id"], dtype="<i8")
                    held[block] = BlockTopK(_matrix(row, "q_"), own, k, best)
                held[block].search(_matrix(row, ""), np.frombuffer(row["ids"], dtype="<i8"))
        for block in list(held):
            yield answer(block)

    return run


def _merged(k: int):
    """The answers to one block of queries from all tasks as one answer: Spark may split the rows of a join over several tasks."""

    def run(answers: pa.Table) -> pa.Table:
        rows = answers.to_pylist()
        count = np.stack([np.frombuffer(r["count"], "<i8") for r in rows], axis=1)
        score, ids = (np.concatenate([np.frombuffer(r[c], "<i8").reshape(-1, k) for r in rows], axis=1) for c in ("score", "id"))
        empty = np.concatenate([np.arange(k)[None, :] >= count[:, i, None] for i in range(len(rows))], axis=1)
        order = np.lexsort((ids, ~score, empty), axis=1)[:, :k]
        total = np.minimum(count.sum(axis=1), k)
        best = [np.take_along_axis(x, order, axis=1) for x in (score, ids)]
        packed = [rows[0]["own"], *[x.astype("<i8").tobytes() for x in (total, *best)]]
        return pa.table({"q_block": pa.array([rows[0]["q_block"]], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("own", "count", "score", "id"), packed)}})

    return run


def _kth(k: int):
    """Packed answers of the first pass: the kth best score and id of each query (the lowest and highest where there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, least_id = [], []
            for row in batch.select(["score", "id"]).to_pylist():
                for name, out in (("score", least), ("id", least_id)):
                    out.append(np.frombuffer(row[name], "<i8").reshape(-1, k)[:, -1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_block"), pa.array(least, pa.binary()), pa.array(least_id, pa.binary())], names=["q_block", "q_least", "q_least_id"]
            )

    return run


def _rows(k: int):
    """Packed answers as rows query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, count, score, ids = (np.frombuffer(row[c], "<i8") for c in ("own", "count", "score", "id"))
                keep = (np.arange(k)[None, :] < count[:, None]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, k)[keep]), pa.array(ids[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"]
                )

    return run


_ANSWER = "q_block long, own binary, count binary, score binary, id binary"


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row for which is_query holds, among all other rows."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("vector"), is_query.alias("ask"))
    rows = rows.where("id is not null and vector is not null")
    total, asking = rows.agg(F.count("*"), F.count_if("ask")).first()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # as many ranges as full ones need, but enough to keep the session's partitions busy
    ranges = max(min(n, -(-total // BLOCK)), -(-total // CANDIDATES))
    dealt = rows.select("id", "vector").repartitionByRange(ranges, "id").sortWithinPartitions("id")
    candidates = stored(dealt.mapInArrow(_pack(CANDIDATES), _PACKED), "candidates")
    blocks = -(-asking // QUERIES)
    asked = rows.where("ask").select("id", "vector").distinct().repartition(blocks).sortWithinPartitions("id").mapInArrow(_pack(QUERIES), _PACKED)
    asked = asked.select(F.monotonically_increasing_id().alias("q_block"), *[F.col(c).alias("q_" + c) for c in asked.columns if c not in ("part", "at")])
    asked = stored(asked, "queries")

    # ranges by number: those that begin below HOME rows are searched first
    per_part = candidates.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy("part")
    first = int(per_part.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).where(F.col("before") < HOME).agg(F.max("part")).first()[0])
    parts = int(candidates.agg(F.max("part")).first()[0])
    chain = max(1, min(CHAIN, (parts - first) // (2 * n)))
    chains = -(-(parts - first) // chain)

    def meet(queries: DataFrame, ranges_of: DataFrame, many: int) -> DataFrame:
        """Every block of queries with every range of every chain 0 .. many - 1. Where chains are few, each is copied for `copies` groups
        of query blocks, to keep all tasks busy."""
        copies = max(1, min(blocks, -(-2 * n // many)))
        left = queries.withColumn("copy", F.pmod(F.xxhash64("q_block"), F.lit(copies)).cast("int"))
        left = left.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        right = ranges_of.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return left.join(right.hint("merge"), ["chain", "copy"]).mapInArrow(_search(k), _ANSWER)

    none = F.lit(None).cast("binary")
    home = candidates.where(F.col("part") <= first).withColumn("chain", F.lit(0))
    near = meet(asked.withColumn("q_least", none).withColumn("q_least_id", none), home, 1)
    near = stored(near.groupBy("q_block").applyInArrow(_merged(k), _ANSWER), "near")
    found = near
    if chains:
        floors = near.mapInArrow(_kth(k), "q_block long, q_least binary, q_least_id binary")
        rest = candidates.where(F.col("part") > first).withColumn("chain", F.pmod(F.col("part"), F.lit(chains)).cast("int"))
        found = near.unionByName(meet(asked.join(floors, "q_block"), rest, chains))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.mapInArrow(_rows(k), "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
