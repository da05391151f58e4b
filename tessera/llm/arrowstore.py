"""Operator 8: token ids in Arrow files of fixed-size-list batches, with zero-copy random access.

`write_tokens` sorts documents by doc_id (a range partitioning; no task sees more than its range), encodes
them and writes for each range one Arrow IPC file: rows of `ids: fixed_size_list<uint16|uint32>[width]` and
`mask: fixed_size_list<bool>[width]` (false where the last row is padded), and beside it an index file with
doc_id, start and n_tokens of each document. The stream of ids runs over the rows. Every row has the same
length, and every record batch but the last the same number of rows, so row i of a mapped file is found without
reading another one (`SequenceFile`).

Ties and repeats: rows of one doc_id stay together, ordered by text. Null text is an empty document of one
end id; null doc_id sorts first. An empty table gives no file and no rows. Very long texts run over as many rows as they
need. Other columns are ignored, whatever their names.
A task writes under a name of its own, and only the names of tasks that ended are in the manifest, which is
kept in the shared folder: a lost executor or a second attempt leaves at most a file that nothing reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, files_at, folder, saved, texts_of
from tessera.llm.tokens import encoder

WIDTH = 1024
ROWS_PER_RECORD_BATCH = 64
END = 0
_ROWS = b"rows_per_record_batch"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(width: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))], {_ROWS: str(ROWS_PER_RECORD_BATCH)})


class _Shard:
    """Writes one stream of ids as fixed-length rows, holding one record batch at a time."""

    def __init__(self, uri: str, width: int, kind: np.dtype):
        self.system, path = files_at(uri)
        self.width, self.kind = width, kind
        self.schema = _schema(width, pa.from_numpy_dtype(kind))
        self.sinks = [self.system.open_output_stream(f"{path}{end}") for end in (".arrow", ".index.arrow")]
        self.rows, self.index = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, _INDEX), strict=True))
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        counts = np.diff(offsets)
        starts = self.total + offsets[:-1]
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=_INDEX))
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.width * ROWS_PER_RECORD_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write what fills record batches; what is left waits for the next ids, or is the last batch."""
        flat = np.concatenate([np.zeros(0, self.kind), *self.held])
        step = self.width * ROWS_PER_RECORD_BATCH
        full = len(flat) // step * step
        for at in range(0, full, step):
            self._write(flat[at : at + step], np.ones(step, bool))
        rest = flat[full:]
        if last and len(rest):
            size = -(-len(rest) // self.width) * self.width
            self._write(np.pad(rest, (0, size - len(rest))), np.arange(size) < len(rest))
            rest = rest[:0]
        self.held, self.waiting = [rest], len(rest)

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask)]
        self.rows.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.rows, self.index, *self.sinks):
            x.close()


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each document."""
    return np.insert(ids, offsets[1:], end).astype(np.uint32, copy=False), offsets + np.arange(len(offsets))


def write_tokens(docs: DataFrame, tokenizer: str, where: str | None = None, width: int = WIDTH) -> DataFrame:
    """Write the shards; returns the manifest: shard int, path string, n_docs long, n_tokens long."""
    spark = docs.sparkSession
    where = where or folder(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, n_docs = None, 0
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        kind = np.dtype(np.uint16 if encode.model.get_vocab_size() <= 1 << 16 else np.uint32)
        path = f"{where}/shard-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or _Shard(path, width, kind)
            doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for first, ids, offsets in encode.encode(texts):
                shard.add(doc_ids[first : first + len(offsets) - 1], *with_end(ids, offsets))
            n_docs += batch.num_rows
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [path], "n_docs": [n_docs], "n_tokens": [shard.total]})

    files_at(where)[0].create_dir(files_at(where)[1], recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")


class SequenceFile:
    """Random access to the rows of one shard. A file on a local path is mapped: its rows aren't copied."""

    def __init__(self, uri: str):
        system, path = files_at(f"{uri}.arrow")
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.width = self.reader.schema.field("ids").type.list_size
        self.rows = int(self.reader.schema.metadata[_ROWS])

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file where it is mapped) and masks of record batch i, one row for each sequence."""
        x = self.reader.get_batch(i)
        ids = x.column("ids").flatten().to_numpy(zero_copy_only=True)
        mask = x.column("mask").flatten().to_numpy(zero_copy_only=False)
        return ids.reshape(-1, self.width), mask.reshape(-1, self.width)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence `row`: all record batches but the last have the same number of rows, so its place is known."""
        i, at = divmod(row, self.rows)
        ids, mask = self.batch(i)
        return ids[at], mask[at]

    def ids(self) -> Iterator[np.ndarray]:
        """The stream of ids without padding, a record batch at a time."""
        for i in range(self.reader.num_record_batches):
            ids, mask = self.batch(i)
            yield ids[mask] if not mask[-1, -1] else ids.ravel()


def read_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids, if asked for)."""
    rows = sorted((r.shard, r.path, r.n_tokens) for r in manifest.collect())  # one row per file
    before, todo = 0, []
    for shard, path, n in rows:
        todo.append((shard, path, before))
        before += n
    files = spark.createDataFrame(todo or [(0, "", 0)], "shard int, path string, base long").filter("path <> ''")
    extra = [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *extra])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = SequenceFile(row["path"]).ids()
                system, path = files_at(f"{row['path']}.index.arrow")
                now, at = np.zeros(0, np.uint32), 0
                with system.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        sums, lists = [], []
                        for n in part.column("n_tokens").to_pylist():
                            crc, own = 0, []
                            while n:
                                if at == len(now):
                                    now, at = next(stream).astype("<u4"), 0
                                piece = now[at : at + n]
                                crc = zlib.crc32(piece.data, crc)
                                own.append(piece) if with_ids else None
                                n -= len(piece)
                                at += len(piece)
                            sums.append(crc)
                            lists.append(np.concatenate(own).astype(np.int32)) if with_ids else None
                        columns = [part.column("doc_id"), pa.array(part.column("start").to_numpy() + row["base"]), part.column("n_tokens"), pa.array(sums, pa.int64())]
                        yield pa.record_batch([*columns, *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else [])], schema=schema)

    return files.repartitionByRange(max(1, len(todo)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op8_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, manifest)
