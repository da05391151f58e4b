"""Operator 2: WARC archives as a table of chunks.

Writing: of pages with equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is a
`response`, the others are `revisit` records that refer to it and hold no payload; smaller payloads are all
responses. Copies are found by digest with a partial aggregation; digests that hold more than 1/256 of all rows
(so 255 at most) are broadcast, and the pages of the other digests that repeat are joined by a shuffle; the rest stay
where they are. Each record is a gzip member of its own, as is usual for WARC, and a task writes its records to archives of
about ARCHIVE_BYTES.

Reading: `read_chunks` streams an archive and yields one row for each chunk of a payload: record_id, chunk
(from 0), data, offset, and the digests up to there (sha256 and bytes so far); the last chunk has the record's
fields. No more than CHUNK bytes of a payload are held at once. A payload whose digest or length isn't that
of its headers raises ValueError.

Null html is an empty payload. Rows that repeat a page_id are records of their own; of equal rows with the
smallest page_id each is a response. Null page_id comes after all others. An empty table gives no archive.
Very long payloads are written and read in pieces of CHUNK. Other columns are ignored, whatever their names. Archives
have names of their own for each attempt, and only those in the manifest are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import files_at, folder, join_by_count, saved, tuned

LEAST_REVISIT = 100
CHUNK = 1 << 18
ARCHIVE_BYTES = 1 << 30
#: Digests that repeat fall in so many slots, which are broadcast; pages in other slots need no join.
SLOTS = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> Iterator[bytes]:
    """The bytes of a record, in pieces of CHUNK at most."""
    block = _HTTP if not revisit else b""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", _PROFILE)] if revisit else [("Content-Type", "application/http; msgtype=response")]),
        ("Content-Length", str(len(block) + (0 if revisit else len(payload)))),
    ]
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block
    if not revisit:
        view = memoryview(payload)
        for at in range(0, len(payload), CHUNK):
            yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, first (smallest page_id of a payload that repeats, else null), revisit."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= LEAST_REVISIT
    groups = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = saved(groups.filter("n > 1"), "copies")
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    slots = F.broadcast(saved(groups.select(slot.alias("slot")).distinct(), "slots"))  # SLOTS at most
    rows = rows.withColumn("slot", slot)
    some = join_by_count(rows.join(slots, "slot", "left_semi"), groups, "digest", "n", pages.count(), "left")
    columns = ["page_id", "url", "payload", "digest", "first"]
    both = some.select(*columns).unionByName(rows.join(slots, "slot", "left_anti").withColumn("first", F.lit(None).cast("long")).select(*columns))
    return both.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))


def write_archives(pages: DataFrame, where: str | None = None) -> DataFrame:
    """Write the archives; returns the manifest: path string, records long, bytes long."""
    where = where or folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files_at(where)
        sink, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{path}/{name}", compression=None)
                page_id, url, payload, digest, first, revisit = row
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                for piece in record(page_id, url, payload, digest, first, revisit):
                    if out := member.compress(piece):
                        size += len(out)
                        sink.write(out)
                out = member.flush()
                sink.write(out)
                size, n = size + len(out), n + 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"], "records": [n], "bytes": [size]})
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{where}/{name}"], "records": [n], "bytes": [size]})

    system, path = files_at(where)
    system.create_dir(path, recursive=True)
    return saved(decided(pages).mapInArrow(write, "path string, records long, bytes long"), "manifest")


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("an archive is cut off")
    return data


def chunks(source) -> Iterator[dict]:
    """The chunk rows of an archive that is open for reading (decompressed)."""
    while line := source.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        fields = {}
        while line := source.readline().strip():
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        left = int(fields["content-length"])
        kind = fields["warc-type"]
        while kind == "response":
            line = source.readline()
            left -= len(line)
            if not line.strip():
                break
        digest, size, number = hashlib.sha256(), 0, 0
        while True:
            data = _exactly(source, min(left, CHUNK))
            left -= len(data)
            digest.update(data)
            row = {"record_id": fields["warc-record-id"], "chunk": number, "offset": size, "data": data, "sha256": digest.hexdigest(), "bytes": size + len(data), "last": not left, "record_type": None, "refers_to": None, "payload_digest": None, "payload_bytes": None}
            size, number = size + len(data), number + 1
            if left:
                yield row
                continue
            told = fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (told != row["sha256"] or size != int(fields["x-payload-length"])):
                raise ValueError(f"the payload of {row['record_id']} isn't that of its headers")
            yield row | {"record_type": kind, "refers_to": fields.get("warc-refers-to"), "payload_digest": told, "payload_bytes": int(fields["x-payload-length"])}
            break
        if _exactly(source, 4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end")


_CHUNKS = pa.schema(
    [("record_id", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("sha256", pa.string()), ("bytes", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
)


def read_chunks(manifest: DataFrame, data: bool = True) -> DataFrame:
    """One row per chunk of the archives of the manifest, read as streams; without data, if that isn't asked for."""
    schema = _CHUNKS if data else _CHUNKS.remove(_CHUNKS.get_field_index("data"))
    ddl = "record_id string, chunk long, offset long, " + "data binary, " * data + "sha256 string, bytes long, last boolean, record_type string, refers_to string, payload_digest string, payload_bytes long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = files_at(uri)
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, CHUNK)) as plain:
                    rows, size = [], 0
                    for row in chunks(io.BufferedReader(plain, CHUNK)):
                        size += len(row["data"])
                        rows.append(row if data else {k: v for k, v in row.items() if k != "data"})
                        if size >= 4 * CHUNK or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(4 * n, "path").mapInArrow(read, ddl)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_chunks(write_archives(tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")), data=False).filter("last")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
