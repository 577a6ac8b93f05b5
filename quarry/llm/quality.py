"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1, unlabelled text is drawn from all documents; rows labelled 0 are not used. The model adds
up a weight for the quantile bin of every style feature and the mean-like sum of the weights of a text's hashed words and word
pairs (BUCKETS of them). It is fitted by stochastic gradient descent on the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),   with the logistic loss,

and its sigmoid is the score. Last, the bias is chosen so that the same risk with the zero-one loss is smallest for the decision
score >= THRESHOLD (of equal risks, for the strictest one).

The class prior is estimated from positives and unlabelled texts alone: FOLDS times, a plain classifier of the one against the
other is fitted without one fold of each sample and applied to that fold. The share of unlabelled texts above a cut, divided by the
share of positives above it, cannot fall below the prior, and comes near it where a cut leaves hardly any negatives; the
prior is this quotient at the cut where it, with a margin for chance, is smallest.

The fit is on the driver and uses bounded samples, chosen by a hash of the id, one row an id: `positives` labelled rows and
`unlabelled` rows. Larger ones narrow the error of the prior and of the weights and change nothing else (README gives held-out
figures for smaller ones). Scoring covers every row in one narrow pass.

Defined results: null and empty texts are scored as empty ones; very long texts are read whole, one at a time; labels that are
null or have a null id are ignored, repeated ones count by distinct doc_id (1 if any row says 1); a doc_id with several texts is
learnt from one of them; without positives, or without documents to learn from, every score is 0.5; repeated rows are scored row
by row; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, table

POSITIVES = 15_000  # bound of the sample of trusted positives
UNLABELLED = 30_000  # bound of the sample of unlabelled documents
BINS = 16
BUCKETS = 512  # hashed words and word pairs
STEPS = 400
STEP_ROWS = 2048  # positives in one step, at most; twice as many unlabelled rows
FOLDS = 5
PLAIN_STEPS = 60  # of the classifiers that the prior is read from
PLAIN_PENALTY = 1e-2
PENALTY = 1e-3
THRESHOLD = 0.3

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FEATURES = 22


def features(body: bytes | None) -> list[float]:
    """Counts and shares that tell running prose from lists, shouting, symbols, boilerplate and repetition."""
    body = body or b""
    n = len(body)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(body, dtype=np.uint8), minlength=256)
    share = lambda *ranges: float(sum(counts[a:b].sum() for a, b in ranges)) / n
    tokens = body.split()
    m = max(1, len(tokens))
    lines = [x for x in body.split(b"\n") if x.strip()]
    words = _WORD.findall(body)
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words)) if words else np.zeros(1)
    distinct = len(set(tokens))
    return [
        np.log1p(n),
        np.log1p(len(tokens)),
        np.log1p(len(lines)),
        share((65, 91)),
        share((97, 123), (128, 256)),
        share((48, 58)),
        share((33, 48), (58, 65), (91, 97), (123, 127)),
        float(counts[46] + counts[33] + counts[63]) / m,
        float(counts[44]) / m,
        float(counts[124]) / m,
        float(counts[33]) / m,
        float(counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / m,
        float(counts[47] + counts[58] + counts[64]) / m,
        float(counts[60] + counts[62] + counts[123] + counts[125] + counts[61] + counts[95]) / m,
        float(sizes.mean()),
        float((sizes <= 3).mean()),
        float((sizes >= 12).mean()),
        distinct / m,
        distinct / np.sqrt(m),
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        len(words) / m,
    ]


class _Hashes(dict):
    """The 64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed(body: bytes | None, hashes: _Hashes) -> np.ndarray:
    """The distinct buckets of a text's words and pairs of words, in order."""
    words = _WORD.findall(body.translate(_LOWER)) if body else []
    if not words:
        return np.zeros(0, dtype="<u2")
    x = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
    there = np.zeros(BUCKETS, dtype=bool)
    for part in (x, pairs):
        there[(part >> np.uint64(40)) % np.uint64(BUCKETS)] = True
    return np.flatnonzero(there).astype("<u2")


@dataclass
class Rows:
    """Texts as features: style (one row each) and the buckets of all texts one after another, with their number for each text."""

    style: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, bodies: list[bytes | None], hashes: _Hashes) -> Rows:
        found = [hashed(b, hashes) for b in bodies]
        style = np.array([features(b) for b in bodies], dtype=np.float64).reshape(-1, FEATURES)
        return cls(style, np.concatenate([np.zeros(0, "<u2"), *found]), np.array([len(f) for f in found], dtype=np.int64))

    def __len__(self) -> int:
        return len(self.style)


class QualityModel:
    """edges: features x (BINS - 1). weights: those of all bins, of all buckets, and the bias."""

    def __init__(self, edges: np.ndarray | None, weights: np.ndarray | None = None):
        self.edges, self.weights = edges, weights

    def score(self, rows: Rows) -> np.ndarray:
        if self.edges is None:
            return np.full(len(rows), 0.5)
        w, bins = self.weights, _bins(self.edges, rows)
        row = np.repeat(np.arange(len(rows)), rows.counts)
        words = np.bincount(row, w[BINS * FEATURES + rows.buckets], minlength=len(rows))
        return _sigmoid(w[-1] + w[bins].sum(axis=1) + words * _share(rows))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bins(edges: np.ndarray, rows: Rows) -> np.ndarray:
    """The place of the weight of every style feature's bin."""
    return np.array([np.searchsorted(edges[j], rows.style[:, j], side="right") + j * BINS for j in range(FEATURES)]).T.reshape(-1, FEATURES)


def _share(rows: Rows) -> np.ndarray:
    """What each bucket of a text counts: texts with many words weigh no more than others."""
    return 1 / np.sqrt(np.maximum(1, rows.counts))


class Design:
    """The factors of the weights of each text, as places: those of its bins and, all texts one after another, of its buckets."""

    def __init__(self, edges: np.ndarray, rows: Rows):
        self.bins = _bins(edges, rows).astype(np.int16)
        self.buckets, self.share = rows.buckets, _share(rows).astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(rows.counts)])

    def __len__(self) -> int:
        return len(self.bins)

    def of(self, chosen: np.ndarray) -> np.ndarray:
        """The rows of `chosen` as a matrix."""
        counts = self.start[chosen + 1] - self.start[chosen]
        row = np.repeat(np.arange(len(chosen)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + self.start[chosen][row]
        out = np.zeros((len(chosen), FEATURES * BINS + BUCKETS + 1), dtype=np.float32)
        out[np.arange(len(chosen))[:, None], self.bins[chosen]] = 1
        out[row, FEATURES * BINS + self.buckets[place]] = self.share[chosen][row]
        out[:, -1] = 1
        return out

    def outputs(self, w: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The outputs for the rows of `chosen`, a part at a time."""
        return np.concatenate([self.of(chosen[at : at + STEP_ROWS]) @ w for at in range(0, len(chosen), STEP_ROWS)] or [np.zeros(0, np.float32)])


def design(edges: np.ndarray, rows: Rows) -> Design:
    return Design(edges, rows)


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk, prior * R_p(+1) and R_u(-1) - prior * R_p(-1), from the outputs for positives and unlabelled rows."""
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(p).mean(), loss(-u).mean() - prior * loss(-p).mean()


def _descend(positive: Design, unlabelled: Design, of_p: np.ndarray, of_u: np.ndarray, steps: int, penalty: float, bias: float, gradient) -> np.ndarray:
    """Weights after `steps` of Adam over batches of both samples' rows of_p and of_u; only a batch is a matrix. gradient(p, u): the derivative for each output, times their number."""
    w = np.zeros(FEATURES * BINS + BUCKETS + 1, dtype=np.float32)
    w[-1] = bias
    first, second = np.zeros(len(w)), np.zeros(len(w))
    rng = np.random.default_rng(11)
    draw = lambda x, most: x[rng.integers(0, len(x), most)] if len(x) > most else x
    for turn in range(1, steps + 1):
        p, u = positive.of(draw(of_p, STEP_ROWS)), unlabelled.of(draw(of_u, 2 * STEP_ROWS))
        each_p, each_u = gradient(p @ w, u @ w)
        g = each_p @ p / len(p) + each_u @ u / len(u)
        g[:-1] += penalty * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        rate = 0.05 * min(1.0, 2 * (1 - (turn - 1) / steps))  # falls in the second half
        w -= (rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return w


def estimate_prior(positive: Design, unlabelled: Design) -> float:
    """The share of positives among unlabelled rows, from the two samples alone."""
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return 0.5
    of_p, of_u = [], []
    for k in range(FOLDS):
        out_p, out_u = np.arange(len(positive)) % FOLDS == k, np.arange(len(unlabelled)) % FOLDS == k
        w = _descend(positive, unlabelled, np.flatnonzero(~out_p), np.flatnonzero(~out_u), PLAIN_STEPS, PLAIN_PENALTY, 0.0, lambda p, u: (_sigmoid(p) - 1, _sigmoid(u)))
        of_p.append(positive.outputs(w, np.flatnonzero(out_p)))
        of_u.append(unlabelled.outputs(w, np.flatnonzero(out_u)))
    p, u = np.sort(np.concatenate(of_p)), np.sort(np.concatenate(of_u))
    above_p, above_u = _above(p, p), _above(u, p)
    chance = np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p)))
    cut = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[cut] / above_p[cut], 0.01, 0.99))


def _above(ordered: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The share of values at or above each cut."""
    return 1 - np.searchsorted(ordered, cuts, side="left") / len(ordered)


def decision(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The output at which to decide for positive: that with the smallest zero-one risk, the highest of equal ones."""
    cuts = np.sort(p)
    above = _above(cuts, cuts)
    risk = prior * (1 - above) + np.maximum(0, _above(np.sort(u), cuts) - prior * above)
    cut = cuts[np.flatnonzero(risk <= risk.min() + 1e-12)[-1]]
    lower = u[u < cut]
    return float((cut + lower.max()) / 2 if len(lower) else cut)


def fit(positive: Rows, unlabelled: Rows, prior: float | None = None) -> QualityModel:
    """Minimises the non-negative risk. Without a prior, it is estimated."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(None)
    edges = np.quantile(np.concatenate([positive.style, unlabelled.style]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    of_p, of_u = design(edges, positive), design(edges, unlabelled)
    prior = estimate_prior(of_p, of_u) if prior is None else prior

    def gradient(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good, rest_p, rest_u = prior * (_sigmoid(p) - 1), -prior * _sigmoid(p), _sigmoid(u)
        if non_negative_risk(p, u, prior)[1] >= 0:
            return good + rest_p, rest_u
        return -rest_p, -rest_u  # below zero the estimate over-fits: step back

    all_p, all_u = np.arange(len(of_p)), np.arange(len(of_u))
    w = _descend(of_p, of_u, all_p, all_u, STEPS, PENALTY, float(np.log(prior / (1 - prior))), gradient)
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - decision(of_p.outputs(w, all_p), of_u.outputs(w, all_u), prior)
    return QualityModel(edges, w)


def _features(docs: DataFrame) -> DataFrame:
    """docs: key, id, body. key, id and the features, packed: style as doubles, buckets as 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, "body"):
            bodies = batch.column("body").to_pylist()
            packed = [np.asarray(features(b), dtype="<f8").tobytes() + hashed(b, hashes).tobytes() for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(packed, pa.binary())], names=["key", "id", "x"])

    return docs.mapInArrow(run, "key int, id long, x binary")


def _unpacked(packed: list[bytes]) -> Rows:
    style = np.array([np.frombuffer(x, "<f8", FEATURES) for x in packed]).reshape(-1, FEATURES)
    buckets = [np.frombuffer(x, "<u2", offset=8 * FEATURES) for x in packed]
    return Rows(style, np.concatenate([np.zeros(0, "<u2"), *buckets]), np.array([len(b) for b in buckets], dtype=np.int64))


def samples(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> DataFrame:
    """key (1: positive, 0: unlabelled), id and features of both samples, one row for each key and id."""
    judged = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 1).alias("y")).where("id is not null and y").select("id").distinct()
    by_hash = F.xxhash64(F.lit(17), F.col("id"))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    positive = judged.orderBy(by_hash, "id").limit(positives)
    plain = ids.orderBy(by_hash, "id").limit(unlabelled)
    chosen = positive.withColumn("key", F.lit(1)).unionByName(plain.withColumn("key", F.lit(0)))  # bounded by the two limits
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).join(F.broadcast(chosen), "id")
    return _features(rows.select("key", "id", "body")).groupBy("key", "id").agg(F.min("x").alias("x"))


def learn(docs: DataFrame, labels: DataFrame, **how) -> QualityModel:
    """docs and labels hold training rows only. how: as in samples(). Two rows an id and no more come to the driver."""
    found = samples(docs, labels, **how).toArrow()
    key, order = found.column("key").to_numpy(), np.lexsort((found.column("id").to_numpy(), found.column("key").to_numpy()))
    packed = found.column("x").to_pylist()
    pick = lambda k: _unpacked([packed[i] for i in order if key[i] == k])
    return fit(pick(1), pick(0))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, "body"):
            found = shared.value.score(Rows.of(batch.column("body").to_pylist(), hashes))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    training = ~held_out(F.col("doc_id"))
    found = score(docs, learn(docs.where(training), labels.where(training)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
