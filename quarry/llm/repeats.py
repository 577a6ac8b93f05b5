"""Exchange of text fingerprints between batches of documents.

The search for repeated text needs every position of every document to learn whether an earlier document has the same text
there. Sending positions one by one would move many times the input. Instead documents are packed into batches of a few MB;
a batch sends each bucket one packed list of fingerprints (sorted, each once), the bucket compares the lists of all batches,
and answers each list with a packed list of the same order. Positions never travel: a batch works out its fingerprints again
from its text and reads the answers beside them.

A fingerprint that stands in very many documents is one entry per batch, so no bucket holds more than the number of batches
of it. Buckets are a hash of the fingerprint. Their number follows the packed bytes (one for BUCKET_BYTES of text, and enough to
keep all tasks busy), so a bucket's size does not grow with the input.

The packed batches are written once, bucketed by batch, so that joining answers to texts moves the answers only. They are a table of
the session's catalog, as Spark writes buckets for tables only; `discard` drops it with its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import TABLES, WRITTEN, shared_dir, slices, stored

BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Rows without an id are later than every other row.
NO_ID = np.iinfo(np.int64).max

_PACKED = "batch long, n_bytes long, ids binary, sizes binary, body binary"


@dataclass
class Batch:
    """Some documents of the corpus, one after another."""

    number: int
    ids: np.ndarray  # int64, NO_ID for null
    sizes: np.ndarray  # bytes of each text
    body: bytes

    def texts(self) -> list[bytes]:
        ends = np.cumsum(self.sizes)
        return [self.body[e - n : e] for e, n in zip(ends.tolist(), self.sizes.tolist())]


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents as packed batches, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(slices(batches, "body", BATCH_BYTES)):
            bodies = [b or b"" for b in batch.column("body").to_pylist()]
            ids = batch.column("id").fill_null(NO_ID).to_numpy().astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([(TaskContext.get().partitionId() << 32) | seq], pa.int64()),
                    "n_bytes": pa.array([sum(map(len, bodies))], pa.int64()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "sizes": pa.array([np.array([len(b) for b in bodies], dtype="<i8").tobytes()], pa.binary()),
                    "body": pa.array([b"".join(bodies)], pa.binary()),
                }
            )

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    name = f"quarry_batches_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    WRITTEN.append(path)
    TABLES[path] = name
    packed = rows.mapInArrow(run, _PACKED).write.option("path", path)
    packed.option("compression", "zstd").bucketBy(buckets(docs), "batch").saveAsTable(name)
    return spark.table(name)


def bucket_count(corpus: DataFrame) -> int:
    """The number of buckets for a packed corpus."""
    total = corpus.agg(F.sum("n_bytes")).first()[0] or 0
    return max(2 * buckets(corpus), -(-total // BUCKET_BYTES))


def buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batches_of(source: Iterator[pa.RecordBatch], *answers: str) -> Iterator[tuple[Batch, list[dict[int, bytes]]]]:
    """The batches of some record batches, each with its answers by bucket."""
    for arrow in source:
        for i in range(arrow.num_rows):
            row = arrow.slice(i, 1)
            get = lambda name: row.column(name)[0].as_py()  # noqa: B023, E731
            batch = Batch(get("batch"), np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("sizes"), "<i8"), get("body"))
            yield batch, [{x["bucket"]: x["answer"] for x in get(name) or ()} for name in answers]


def ask(
    corpus: DataFrame,
    answers: tuple[str, ...],
    entries: Callable[..., Iterator[tuple[int, bytes]]],
    compare: Callable[[list[bytes], int], list[bytes]],
    name: str,
) -> DataFrame:
    """corpus with one more column of answers.

    entries(batch, *answers) gives (bucket, packed list) pairs; compare gets the lists of one bucket, and its number, and answers each.
    """

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, known in batches_of(source, *answers):
            found = list(entries(batch, *known))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.number] * len(found), pa.int64()),
                    pa.array([k for k, _ in found], pa.int32()),
                    pa.array([data for _, data in found], pa.binary()),
                ],
                names=["batch", "bucket", "data"],
            )

    def answer(lists: pa.Table) -> pa.Table:
        replies = compare(lists.column("data").to_pylist(), lists.column("bucket")[0].as_py())
        return pa.table({"batch": lists.column("batch"), "bucket": lists.column("bucket"), "answer": pa.array(replies, pa.binary())})

    sent = corpus.mapInArrow(send, "batch long, bucket int, data binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, answer binary")
    per_batch = replies.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    return corpus.join(stored(per_batch, name).hint("shuffle_hash"), "batch", "left")


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each 64-bit number."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def named(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """The name of each pair: equal pairs get equal names in every task."""
    return mix(mix(left, seed) + right, seed + 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` numbers in a row."""
    out, have = x, 1
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys, 77) % np.uint64(n)).astype(np.int64)


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """True at each position within `width` of a start at or before it."""
    ends = np.bincount(np.minimum(starts + width, length), minlength=length + 1)
    return np.cumsum(np.bincount(starts, minlength=length + 1) - ends)[:length] > 0
