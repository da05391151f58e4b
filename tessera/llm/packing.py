"""Operator 1: packing of tokenised documents into windows by a non-negative least-squares plan.

A document of n ids is cut into n // W full windows, which are sequences of their own, and a remainder.
Remainders are packed by their histogram, which has W - 1 entries whatever the size of the corpus:

1. All length combinations of at most three parts that fill a window are enumerated.
2. min ||A x - h||, x >= 0, is solved for their repeat counts (accelerated projected gradient; after the 200 rounds the squared
   residual is within 0.3 % of |h|^2 of what 1,000 rounds give, and what is left goes to the residual's packing).
3. The counts are rounded, largest first, to what the histogram still holds.
4. The residual is packed greedily by best fit, again on the histogram: a combination is repeated as often
   as its parts last. Combinations that leave more than 1 % of the window empty aren't used; what is left
   then is laid end to end and cut at the windows, so that only the last sequence has more padding.

The plan is a table of slots: remainders of one length, numbered by (input partition, position), find their
sequence and offset by their number alone. Only the histogram and the plan visit the driver. Numbers come from
counts for each (input partition, length), so a length that a third of all documents share is no hot key.

Null or empty text is a document of one end id. Rows that repeat a doc_id or a text are documents of their
own. An empty table gives no rows. Very long texts are encoded in runs and cut into as many windows as they fill. Other columns are
ignored, whatever their names. Sequences are numbered from 0 without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrowstore import with_end
from tessera.llm.common import documents, saved, texts_of
from tessera.llm.tokens import encoder

WINDOW = 1024
#: Least part of a window that a combination of the residual has to fill.
LEAST_FILL = 0.99
#: Most rows of the table of first numbers that are broadcast; with more, it is joined by a shuffle.
MOST_BROADCAST = 500_000


def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, b > 0, a + b + c = window."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def solve(parts: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that makes the combinations use each length as often as the histogram has it, in the least squares."""
    size = len(histogram)
    flat = parts.ravel()

    def use(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, parts.shape[1]), size)
        out[0] = 0
        return out

    def back(y: np.ndarray) -> np.ndarray:
        return y[parts].sum(axis=1)

    h = histogram.astype(float)
    h[0] = 0
    v = np.ones(len(parts))
    for _ in range(12):
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (1.05 * top)
    x = z = np.zeros(len(parts))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(use(z) - h))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (last - 1) / t * (new - x)
        x = new
    return x


class Plan:
    """Slots for the remainders of each length, by number."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        taken = np.zeros_like(left)
        slots: list[tuple[int, int, int, int]] = []  # length, first number, first sequence, offset
        self.sequences = 0

        def book(parts: list[int], times: int) -> None:
            at = 0
            for n in parts:
                slots.append((n, int(taken[n]), self.sequences, at))
                taken[n] += times
                left[n] -= times
                at += n
            self.sequences += times

        if left.sum():
            parts = combinations(window)
            x = solve(parts, left)
            for i in np.argsort(-x, kind="stable").tolist():
                times = int(x[i] + 0.5)
                if not times:
                    break
                own = [int(p) for p in parts[i] if p]
                times = min(times, *(int(left[p]) // own.count(p) for p in own))
                if times:
                    book(own, times)
        for n in range(window - 1, 0, -1):
            while left[n]:
                own, gap = [n], window - n
                while gap:
                    fits = np.flatnonzero(left[1 : gap + 1]) + 1
                    fits = [p for p in fits[::-1].tolist() if left[p] > own.count(p)][:1]
                    if not fits:
                        break
                    own.append(fits[0])
                    gap -= fits[0]
                if window - gap < LEAST_FILL * window:
                    break
                book(own, min(int(left[p]) // own.count(p) for p in set(own)))
        slots.sort()
        self.key = np.array([s[0] << 40 | s[1] for s in slots], np.int64)
        self.sequence = np.array([s[2] for s in slots], np.int64)
        self.offset = np.array([s[3] for s in slots], np.int64)
        self.taken = taken
        lengths = np.arange(len(left))
        self.stream = np.concatenate([[0], np.cumsum(left * lengths)])[:-1]  # where what is left of each length starts
        self.base = self.sequences
        self.sequences += -(-int((left * lengths).sum()) // window)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """(sequence, offset, cut): cut ids go there, the rest to the start of the next sequence."""
        sequence, offset, cut = (np.zeros(len(length), np.int64) for _ in range(3))
        kept = number < self.taken[length]
        if kept.any():
            at = np.searchsorted(self.key, length[kept] << 40 | number[kept], "right") - 1
            sequence[kept] = self.sequence[at] + number[kept] - (self.key[at] & ((1 << 40) - 1))
            offset[kept] = self.offset[at]
        loose = ~kept
        where = self.stream[length[loose]] + (number[loose] - self.taken[length[loose]]) * length[loose]
        sequence[loose], offset[loose] = self.base + where // self.window, where % self.window
        cut[:] = np.minimum(length, self.window - offset)
        return sequence, offset, cut


def tokenised(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n; part: input partition; number, full: remainders of this length, full windows before in it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            texts, doc_ids = texts_of(batch.column(1)), batch.column(0)
            for first, ids, offsets in encoder(tokenizer).encode(texts):
                ids, offsets = with_end(ids, offsets)
                n = np.diff(offsets)
                rest, whole = n % window, n // window
                order = np.argsort(rest, kind="stable")
                runs = rest[order]
                number = np.empty(len(n), np.int64)
                number[order] = seen[runs] + np.arange(len(n)) - np.searchsorted(runs, runs)
                seen += np.bincount(rest, minlength=window)
                raw, ends = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids.slice(first, len(n)),
                        "part": pa.array(np.full(len(n), part, np.int32)),
                        "n": pa.array(n),
                        "number": pa.array(number),
                        "full": pa.array(full + np.cumsum(whole) - whole),
                        "ids": pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    }
                )
                full += int(whole.sum())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(encode, "doc_id long, part int, n long, number long, full long, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    ids = tokenised(docs, tokenizer, window)
    rest = F.col("n") % window
    rests = ids.groupBy("part", rest.alias("size")).agg(F.count("*").alias("k"))
    wholes = ids.groupBy("part").agg(F.lit(window).cast("long").alias("size"), F.sum(F.expr(f"n div {window}")).alias("k"))
    sizes = saved(rests.unionByName(wholes), "sizes")
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    total = {r["size"]: r["k"] for r in sizes.groupBy("size").agg(F.sum("k").alias("k")).collect()}  # window + 1 rows at most
    histogram = np.zeros(window, np.int64)
    for n, k in total.items():
        if n < window:
            histogram[n] = k
    plan, n_full = Plan(histogram, window), total.get(window, 0)

    @F.pandas_udf("sequence_id long, offset long, cut long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset, cut = plan.place(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence + n_full, "offset": offset, "cut": cut})

    hint = F.broadcast if sizes.count() <= MOST_BROADCAST else (lambda x: x)
    rests = first.filter(f"size < {window}").select("part", F.col("size").alias("rest"), F.col("first").alias("first_rest"))
    wholes = first.filter(f"size = {window}").select("part", F.col("first").alias("first_full"))
    joined = ids.withColumn("rest", rest).join(hint(rests), ["part", "rest"]).join(hint(wholes), ["part"])
    placed = joined.withColumn("at", place("rest", F.col("first_rest") + F.col("number")))
    piece = "named_struct('start', {0}, 'length', {1}, 'sequence_id', {2}, 'offset', {3}, 'ids', substring(ids, int(4 * ({0}) + 1), int(4 * ({1}))))"
    full = piece.format(f"j * {window}L", f"{window}L", "first_full + full + j", "0L")
    head = piece.format("n - rest", "at.cut", "at.sequence_id", "at.offset")
    tail = piece.format("n - rest + at.cut", "rest - at.cut", "at.sequence_id + 1", "0L")
    pieces = F.expr(
        f"concat(if(n >= {window}, transform(sequence(0L, n div {window} - 1), j -> {full}), array()), "
        f"if(rest > 0, array({head}), array()), if(rest > at.cut, array({tail}), array()))"
    )
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p")).select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
