"""Operator 4: benchmark decontamination by pigeonhole edit matching.

Normal form of a text: lower case, ASCII characters other than letters and digits are spaces, one space
between words and at both ends, as UTF-8. A document matches an item if a part of its normal form is within the
item's budget of edits, one for each CHARS_PER_EDIT bytes of the item. The item is split into budget + 1 pieces:
a part within the budget holds one of them unchanged. One Aho-Corasick automaton finds the pieces in each whole
document; around each hit, Myers' bit-parallel distance over the item (one machine-independent integer per
column) gives the least distance of a part that ends there. Hits of an item at close diagonals are verified once.

The benchmark is the query set. Its normal forms are written to the shared folder in shards of about SHARD_BYTES (an item is
never split); the driver holds their names. One pass over the documents: a task gathers BUFFER_BYTES of texts and takes
them through shard after shard, with one automaton in memory at a time (if there is one shard, the worker keeps it).
Items that repeat are matched each. An item whose normal form is empty (or null) matches nothing; a null or empty document
matches nothing. Rows that repeat a doc_id give a row each. Empty tables give no rows. Very long texts are searched whole.
Other columns are ignored, or kept as they are by `without_matches`, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, files_at, folder, saved

CHARS_PER_EDIT = 20
SHARD_BYTES = 1 << 22
BUFFER_BYTES = 1 << 26
_KEEP = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None) -> str:
    """The normal form, a character for each byte."""
    words = (text or "").lower().encode().translate(_KEEP).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""


def distances(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of text that is closest to the pattern, the first of them; None if over `most`."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = items
        self.budget = [len(x) // CHARS_PER_EDIT for _, x in items]
        found: dict[str, list] = {}
        for i, (_, x) in enumerate(items):
            pieces = self.budget[i] + 1
            cuts = [len(x) * p // pieces for p in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(x[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, tuple(places))
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of the best part for each item that matches; start and end in the normal form."""
        diagonals: dict[int, list[int]] = {}
        for end, places in self.automaton.iter(text):
            for i, b in places:
                own = diagonals.setdefault(i, [])
                at = end + 1 - b
                if not own or own[-1] != at:
                    own.append(at)
        out = []
        for i, own in diagonals.items():
            item, k = self.items[i][1], self.budget[i]
            best = None
            own = sorted(set(own))
            a = 0
            while a < len(own) and (best is None or best[0]):
                b = a
                while b + 1 < len(own) and own[b + 1] - own[b] <= 2 * k + 1:
                    b += 1
                exact = next((x for x in own[a : b + 1] if text.startswith(item, x) and x >= 0), None)
                if exact is not None:
                    best = (0, exact, exact + len(item))
                else:
                    start = max(0, own[a] - k)
                    near = distances(item, text[start : own[b] + len(item) + k], k)
                    if near and (best is None or near[0] < best[0]):
                        stop = start + near[1]
                        back = distances(item[::-1], text[max(0, stop - len(item) - k) : stop][::-1], k)
                        best = (near[0], stop - back[1] if back else start, stop)
                a = b + 1
            if best:
                out.append((i, *best))
        return out


def shards(benchmark: DataFrame) -> list[str]:
    """Files with the items and their normal forms; the driver sees their names alone."""
    where = folder(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first().n or 0

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files_at(where)
        held: list[tuple[int, bytes]] = []

        def put() -> pa.RecordBatch:
            name = f"shard-{uuid.uuid4().hex}.arrow"
            own = pa.record_batch([pa.array([i for i, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["item_id", "normal"])
            with system.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, own.schema) as file:
                file.write_batch(own)
            return pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"]})

        size = 0
        for batch in parts:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x := normal(text):
                    held.append((item_id, x.encode("latin-1")))
                    size += len(x)
                if size >= SHARD_BYTES:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    files_at(where)[0].create_dir(files_at(where)[1], recursive=True)
    manifest = saved(rows.repartition(-(-size // SHARD_BYTES) or 1).mapInArrow(write, "path string"), "shards")
    return sorted(r.path for r in manifest.collect())  # a name for each SHARD_BYTES


_matchers: dict[str, Matcher] = {}


def _matcher(uri: str) -> Matcher:
    """The automaton of a shard; each Python worker holds one."""
    if uri not in _matchers:
        _matchers.clear()
        system, path = files_at(uri)
        with system.open_input_file(path) as source:
            table = pa.ipc.open_file(source).read_all()
        _matchers[uri] = Matcher([(i, x.decode("latin-1")) for i, x in zip(table["item_id"].to_pylist(), table["normal"].to_pylist(), strict=True)])
    return _matchers[uri]


def _buffered(parts: Iterator[pa.RecordBatch], at: int, files: list[str]) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Runs of batches with BUFFER_BYTES of texts, and the normal forms of these; a batch each if there is one shard."""
    held, texts, size = [], [], 0
    for batch in parts:
        own = [normal(x) for x in batch.column(at).to_pylist()]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size >= BUFFER_BYTES or len(files) < 2:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, distance, start_byte, end_byte (in the normal form)."""
    files = shards(benchmark)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "distance", "start_byte", "end_byte"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffered(parts, 1, files):
            doc_ids = [x for batch in held for x in batch.column(0).to_pylist()]
            for uri in files:
                matcher = _matcher(uri)
                out = [(d, matcher.items[i][0], n, a, b) for d, text in zip(doc_ids, texts, strict=True) for i, n, a, b in matcher.match(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, item_id long, distance int, start_byte long, end_byte long")


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text matches no item."""
    files = shards(benchmark)
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _buffered(parts, at, files):
            clean = np.ones(len(texts), bool)
            for uri in files:
                matcher = _matcher(uri)
                for i in np.flatnonzero(clean).tolist():
                    clean[i] = not matcher.match(texts[i])
            first = 0
            for batch in held:
                yield batch.filter(pa.array(clean[first : first + batch.num_rows]))
                first += batch.num_rows

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
