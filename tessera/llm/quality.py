"""Operator 6: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 toxic, 1 neither toxic nor of quality, 2 not toxic and of quality. With w shared by
all grades, x the hashed features of a text and ordered thresholds t1 < t2: P(grade >= j) = sigmoid(w x - tj).
Features: runs of letters (in lower case), of digits, and of marks, and the number of all-capital runs, hashed;
weights ln(1 + count). The model is fitted on MOST_RATED rated documents at most, chosen by a hash of doc_id (the
documented bound of the sample), by Adam on the likelihood with an L1 penalty, over the features that
LEAST_DOCUMENTS of them have. Each document gets its expected grade and the tail probabilities; `keep` is
P(grade >= 1) >= KEEP, so that likely toxic texts go and others stay.

Null text is an empty one. Labels that are null aren't used; of several labels of a document all count; of several texts of
a rated doc_id the one with the smallest hash is learned from. With no labels, all weights are 0 and both tails 1/2.
Rows that repeat are scored each; an empty table gives no rows. Very long texts are taken whole, in runs of some MB. Null
doc_id stays null and has no label. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytesvec import batches, span_hashes
from tessera.llm.common import documents, texts_of

BUCKETS = 1 << 18
MOST_RATED = 10_000
KEEP = 0.5
LEAST_DOCUMENTS = 5
_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields, for runs of texts, (first, last, row of each entry, bucket, weight), rows counted from first."""
    for first, last in batches(texts):
        data = np.frombuffer(b" ".join([*texts[first:last], b""]), np.uint8)
        kind = _KIND[data]
        edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(data) else np.zeros(0, np.int64)
        stop = np.append(edge[1:], len(data)) if len(data) else edge
        run = kind[edge] > 0 if len(data) else np.zeros(0, bool)
        starts, ends = edge[run], stop[run]
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        loud = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
        bucket = (span_hashes(_LOWER[data], starts, ends) >> np.uint64(46)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[first:last]])])
        row = np.searchsorted(begin, starts, "right") - 1
        key = np.concatenate([row * BUCKETS + bucket, row[loud] * BUCKETS])
        key, count = np.unique(key, return_counts=True)
        row, bucket = key // BUCKETS, key % BUCKETS
        yield first, last, row, bucket, np.log1p(count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: tuple[float, float]):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        z = np.zeros(len(texts))
        for first, last, row, bucket, weight in features(texts):
            z[first:last] = np.bincount(row, self.weights[bucket] * weight, last - first)
        return _sigmoid(z - self.thresholds[0]), _sigmoid(z - self.thresholds[1])


def fit_rows(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, ratings: np.ndarray, rounds: int = 200, rate: float = 0.1, penalty: float = 5e-4) -> Model:
    """Full-batch Adam on the mean negative log-likelihood; t2 = t1 + exp(gap), so the thresholds stay in order.

    row, bucket, weight: the entries of the texts' features; ratings: how often each text has each grade.
    """
    n, total = len(ratings), ratings.sum()
    if not total:
        return Model(np.zeros(BUCKETS), (0.0, 0.0))
    common = np.bincount(bucket, minlength=BUCKETS)[bucket] >= LEAST_DOCUMENTS
    row, bucket, weight = row[common], bucket[common], weight[common]
    used, place = np.unique(bucket, return_inverse=True)
    w = np.zeros(len(used) + 2)
    w[-2:] = (-2.0, 0.5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    low, mid, high = ratings.T
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[place] * weight, n)
        gap = np.exp(w[-1])
        p1, p2 = _sigmoid(z - w[-2]), _sigmoid(z - w[-2] - gap)
        # derivatives of -log P(grade) by p1's and p2's arguments
        middle = np.maximum(p1 - p2, 1e-12)
        d1 = low * p1 - mid * p1 * (1 - p1) / middle
        d2 = mid * p2 * (1 - p2) / middle - high * (1 - p2)
        g = np.append(np.bincount(place, (d1 + d2)[row] * weight, len(used)), [-(d1 + d2).sum(), -d2.sum() * gap]) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= scale * m / (1 - 0.9**t)
        w[:-2] = np.sign(w[:-2]) * np.maximum(np.abs(w[:-2]) - scale[:-2] * penalty, 0)  # the L1 penalty's proximal step
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-2]
    return Model(weights, (float(w[-2]), float(w[-2] + np.exp(w[-1]))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> Model:
    """Learn from `most` rated documents, those with the smallest hashes of doc_id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rated = labels.filter("toxic is not null and quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    rated = rated.groupBy("doc_id").agg(*[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(3)])
    rated = F.broadcast(rated.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(rated, "doc_id")
    joined = joined.groupBy("doc_id", "n0", "n1", "n2").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, last, row, bucket, weight in features(texts_of(batch.column(1))):
                cut = np.searchsorted(row, np.arange(last - first + 1)).tolist()
                ids, values = bucket.astype("<i4"), weight.astype("<f4")
                entries = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (ids, values)]
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column(0), *entries, *own.columns[2:]], names=["doc_id", "ids", "weights", "n0", "n1", "n2"])

    schema = "doc_id long, ids binary, weights binary, n0 long, n1 long, n2 long"
    found = joined.select("doc_id", "text", "n0", "n1", "n2").mapInArrow(run, schema).toLocalIterator()  # `most` rows at most
    rows = sorted(((r.doc_id, np.frombuffer(r.ids, "<i4"), np.frombuffer(r.weights, "<f4"), (r.n0, r.n1, r.n2)) for r in found), key=lambda x: x[0])
    row = np.repeat(np.arange(len(rows)), [len(x[1]) for x in rows]).astype(np.int64)
    bucket, weight = (np.concatenate([np.zeros(0, kind), *(x[i] for x in rows)]).astype(kind) for i, kind in ((1, np.int64), (2, np.float64)))
    return fit_rows(row, bucket, weight, np.array([x[3] for x in rows], np.float64).reshape(-1, 3))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2, keep."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            one, two = model.tails(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one + two), pa.array(one), pa.array(two), pa.array(one >= KEEP)], names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, keep boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grade(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
