"""Work on all pairs of rows, a pair of blocks at a time.

Rows are packed in blocks and written once; a task reads the blocks of two partitions of files, so no row is copied
for the blocks that it meets, and a pair is a row only in what a task returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Rows that a task returns at a time, and bytes of packed blocks that go to a Python worker at a time.
ROWS_OUT, BYTES_IN = 1 << 17, 1 << 24


def _pack(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def in_blocks(df: DataFrame, size: int = 1024) -> DataFrame:
    """b, data: the rows, packed in blocks of `size` (the last of a partition has fewer), written to the shared folder."""
    parts = min(64, max(1, -(-df.count() // (4 * size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        b, held, n = TaskContext.get().partitionId(), [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int64()), "data": pa.array([_pack(rows)], pa.binary())})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                held, n, b = rows.slice(size).to_batches(), n - size, b + parts
        if n:
            yield block(pa.Table.from_batches(held))

    return cut(df.repartition(parts).mapInArrow(run, "b long, data binary"))


def _read(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def _met(blocks: DataFrame) -> DataFrame:
    """p, q, own: the data of each pair of blocks, once for each, and whether they are the same."""
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_IN))
    # of two blocks either one may be the left: that deals the pairs evenly to the pairs of partitions
    once = F.expr("a.b = b.b or (a.b < b.b) = (pmod(a.b + b.b, 2) = 0)")
    both = blocks.alias("a").join(blocks.alias("b").hint("shuffle_replicate_nl"), once)
    return both.select(F.col("a.data").alias("p"), F.col("b.data").alias("q"), F.expr("a.b = b.b").alias("own"))


def meet(blocks: DataFrame, work: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """The rows of work(rows of a block, rows of another, whether they are the same) for each pair of blocks, once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, own in zip(*batch.columns, strict=True):
                a = _read(p)
                yield from work(a, a if own.as_py() else _read(q), own.as_py()).to_batches(ROWS_OUT)

    return _met(blocks).mapInArrow(run, schema)


def meet_in_few(blocks: DataFrame, work: Callable[[Iterator[tuple[pa.Table, pa.Table, bool]]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """The rows of work(all pairs of blocks of a task), so that a task can add up what its pairs give: two tasks for each core, each with its share of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[pa.Table, pa.Table, bool]]:
            for batch in batches:
                for p, q, own in zip(*batch.columns, strict=True):
                    a = _read(p)
                    yield a, a if own.as_py() else _read(q), own.as_py()

        for t in work(pairs()):
            yield from t.to_batches()

    return _met(blocks).coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def column(rows: pa.Table, name: str) -> pa.Array:
    chunks = rows.column(name).chunks
    return chunks[0] if chunks else pa.array([], rows.schema.field(name).type)


def ordered(a: pa.Table, b: pa.Table, own: bool, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(row of a, row of b, i, j): the pairs of the keys `k`, i < j, of those that `keep` (a matrix) says; each once. Null keys have none."""
    x, y = column(a, "k"), column(b, "k")
    p, q = np.nonzero(keep) if keep is not None else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
    i, j = x.take(pa.array(p)), y.take(pa.array(q))
    low = pc.less(i, j)
    use = pc.fill_null(low if own else pc.not_equal(i, j), False)
    at = np.flatnonzero(use.to_numpy(zero_copy_only=False))
    if len(at) < len(p):
        p, q, i, j, low = p[at], q[at], i.take(pa.array(at)), j.take(pa.array(at)), low.take(pa.array(at))
    return p, q, pc.if_else(low, i, j), pc.if_else(low, j, i)


def common(a: pa.Table, b: pa.Table, name: str, width: int = 4096) -> np.ndarray:
    """A matrix of the pairs of rows: how many pairs of equal items their lists have; without nulls."""
    lists = [column(t, name) for t in (a, b)]
    row = [np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in lists]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices
    known = codes.is_valid().to_numpy(zero_copy_only=False)
    code = codes.fill_null(0).to_numpy()
    code, known = (np.split(v, [len(row[0])]) for v in (code, known))
    out = np.zeros((len(lists[0]), len(lists[1])))
    top = max((int(c.max()) for c in code if len(c)), default=-1) + 1
    for low in range(0, top, width):
        n = min(width, top - low)
        hot = []
        for r, c, ok, x in zip(row, code, known, lists, strict=True):
            own = ok & (c >= low) & (c < low + n)
            hot.append(np.bincount(r[own] * n + c[own] - low, minlength=len(x) * n).reshape(len(x), n).astype(float))
        out += hot[0] @ hot[1].T
    return out
