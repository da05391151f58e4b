"""Operator 7: language identification by the nearest of several centroids per language.

Features: n-grams (1 to 3) of the UTF-8 bytes around every letter of the lower-case text (anything in ASCII
that is no letter counts as a space), hashed to DIMENSIONS buckets; weights are (1 + ln count) * idf, of unit
length. The idf comes from all training documents. The centroids of a language are a spherical k-means of at
most PER_LANGUAGE of its training documents, those with the smallest hashes of doc_id, fitted in a task for each language;
the driver and the workers hold CENTROIDS centroids of 16 KB each for a language. A text goes to the language of the
centroid with the highest cosine; it is rejected if its distance is over that language's limit, which is
REACH times the largest distance of a sampled document from its language's centroids, or, if more, LEAST_LIMIT for
texts of SHORT letters, less by the root of the length for longer ones: short texts are far from all centroids.

Null text, or text without a letter: `und`, score 0, rejected. No training rows: `und` for all. Equal texts get
equal predictions; rows that repeat are predicted each. Null lang isn't learned from. Very long texts are taken whole, in
slices. An empty table gives no rows. Other columns are kept as they are, whatever their names, but for lang_pred, score and
rejected, which `identify` replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytesvec import batches
from tessera.llm.common import documents, join_by_count, saved, unit

DIMENSIONS = 1 << 12
CENTROIDS = 4
#: Bound of the sample that the centroids of a language are fitted on (a documented parameter).
PER_LANGUAGE = 1000
REACH = 1.25
LEAST_LIMIT, SHORT = 0.9, 64
UNKNOWN = "und"

_CLEAN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SLICE = 1 << 20
_ROWS = 256  # of a matrix of counts: 4 MB


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Yields, for runs of texts, (first text, matrix of hashed n-gram counts)."""
    raw = [(t or "").lower().encode().translate(_CLEAN) + b"  " for t in texts]
    runs = [(a, min(a + _ROWS, last)) for first, last in batches(raw) for a in range(first, last, _ROWS)]
    for first, last in runs:
        data = np.frombuffer(b"  " + b"".join(raw[first:last]), np.uint8)
        ends = 2 + np.cumsum([len(x) for x in raw[first:last]])
        out = np.zeros((last - first) * DIMENSIONS, np.float32)
        for at in range(2, len(data), _SLICE):
            place = at + np.flatnonzero(data[at : at + _SLICE] != 32)
            here = data[place].astype(np.uint32)
            two = data[place - 1].astype(np.uint32) << np.uint32(8) | here
            three = two << np.uint32(8) | data[place + 1]
            row = np.searchsorted(ends, place, "right") * DIMENSIONS
            for gram in (here | np.uint32(1 << 30), two | np.uint32(1 << 29), three):
                out += np.bincount(row + ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)), minlength=len(out))
        yield first, out.reshape(-1, DIMENSIONS)


def unit_vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means: starts from the mean's nearest row, then the rows farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = x[own == j].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray, limit: np.ndarray):
        self.idf, self.names, self.centres, self.limit = idf, names, centres, limit

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [], [], []
        for first, count in counts(texts):
            cosine = unit_vectors(count, self.idf) @ self.centres.T if len(self.centres) else None
            letters = count.sum(axis=1) / 3
            least = LEAST_LIMIT * np.minimum(1, np.sqrt(SHORT / np.maximum(letters, 1)))
            for i in range(len(count)):
                text = texts[first + i]
                if cosine is None or not text or not any(c.isalpha() for c in text):
                    names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                best = int(np.argmax(cosine[i]))
                score = min(1.0, max(0.0, float(cosine[i, best])))
                names.append(self.names[best]), scores.append(score), rejected.append(1 - score > max(self.limit[best], least[i]) + 1e-6)
        return names, scores, rejected


def fit(docs: DataFrame) -> Model:
    """Learn from the rows with non-null text and lang that aren't held out (crc32(doc_id) mod 4 <> 2)."""
    rows = docs.filter("text is not null and lang is not null").filter(unit() % 4 != 2).select("doc_id", "text", "lang")

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in parts:
            for _, count in counts(batch.column(0).to_pylist()):
                total += (count > 0).sum(axis=0)
                n += len(count)
        if n:
            yield pa.RecordBatch.from_pydict({"df": pa.array(np.append(total, n))})

    sums = rows.select("text").mapInArrow(frequencies, "df long")
    # each partition gives DIMENSIONS + 1 rows in order, so that their numbers modulo that are the buckets
    bucket = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) % (DIMENSIONS + 1)
    df = np.zeros(DIMENSIONS + 1, np.int64)
    for r in sums.groupBy(bucket.alias("b")).agg(F.sum("df").alias("df")).collect():  # DIMENSIONS + 1 rows
        df[r.b] = r.df
    n, df = df[-1], df[:-1]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    sizes = saved(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(0).to_pylist()
            for first, count in counts(texts):
                own = batch.slice(first, len(count))
                data = pa.array([x.tobytes() for x in np.minimum(count, 65535).astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([data, *own.columns[1:]], names=["v", "lang", "draw"])

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("v", "ascending")]).slice(0, PER_LANGUAGE)  # the draw may give a few more
        x = unit_vectors(np.frombuffer(b"".join(table["v"].to_pylist()), "<u2").reshape(-1, DIMENSIONS).astype(np.float32), idf)
        own = cluster(x, CENTROIDS)
        limit = min(1.0, REACH * float(1 - (x @ own.T).max(axis=1).min()))
        return pa.table({"lang": [table["lang"][0].as_py()] * len(own), "centre": pa.array([c.astype("<f4").tobytes() for c in own], pa.binary()), "limit": pa.array([limit] * len(own))})

    total = int(sizes.agg(F.sum("n").alias("n")).first().n or 0)
    drawn = join_by_count(rows, sizes, "lang", "n", total).select("text", "lang", draw.alias("draw"), "n").filter(F.col("draw") < PER_LANGUAGE / F.col("n"))
    vectors = drawn.select("text", "lang", "draw").mapInArrow(sampled, "v binary, lang string, draw double")
    found = vectors.groupBy("lang").applyInArrow(centres, "lang string, centre binary, limit double").collect()  # 16 KB for each centroid
    found.sort(key=lambda r: (r.lang, bytes(r.centre)))
    return Model(idf, [r.lang for r in found], np.frombuffer(b"".join(r.centre for r in found), "<f4").reshape(-1, DIMENSIONS), np.array([r.limit for r in found]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred string, score double and rejected boolean; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*kept).schema
    names = [*kept, "lang_pred", "score", "rejected"]
    at = kept.index("text")

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lang, score, rejected = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    out = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept).mapInArrow(predict, out)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't rejected."""
    at = docs.columns.index("text")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield batch.filter(pa.array([not x for x in model.predict(batch.column(at).to_pylist())[2]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", (unit() % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")
