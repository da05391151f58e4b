"""Operator 5: media in Ogg pages, written and read back.

Format facts (RFC 3533): a page is "OggS", version 0, flags (1 continued, 2 first, 4 last), granule position
(64 bits), serial number, sequence number and checksum (32 bits each), the number of lacing values, these
values, and the body; all little-endian. A packet's lacing values are 255 as long as it goes on, and one
value under 255 ends it. The checksum is the CRC-32 with polynomial 0x04C11DB7, not reflected, from 0, over the
page with the checksum's bytes as 0. It is computed as the mirrored CRC of zlib over mirrored bytes.

`encode` multiplexes two logical streams: 8-bit samples (a header packet, then packets of up to 4,096 samples;
the granule position is the number of samples so far) and checks (a header packet and one packet with the
samples' number and CRC-32). `decode` verifies each page's checksum and order, demultiplexes by serial number,
puts packets together, and derives times from granule positions. A damaged stream raises ValueError.

Null or empty text gives 64 zero bytes; texts that are equal give equal media, and rows that repeat a row each. An empty table gives
no rows. Very long texts are packets over as many pages as they need, held whole, one at a time. Null doc_id stays null. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, saved, texts_of

RATE = 8000
PACKET = 4096
ALIGN = 64
SAMPLES, CHECKS = 1, 2
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 of a page whose checksum bytes are 0."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


class LogicalStream:
    """Pages of one logical stream; a packet may go on over pages."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> list[bytes]:
        """Pages with (packet, granule position at its end); the last packet ends the last page."""
        out, lacing, body, granule, going_on = [], bytearray(), [], -1, False
        for k, (packet, end) in enumerate(packets):
            values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            at = start = 0
            while at < len(values):
                room = 255 - len(lacing)
                if not room:
                    out.append((going_on, granule, bytes(lacing), b"".join(body)))
                    lacing, body, granule, going_on, room = bytearray(), [], -1, at > 0, 255
                own = values[at : at + room]
                stop = len(packet) if at + len(own) == len(values) else start + 255 * len(own)
                lacing += own
                body.append(packet[start:stop])
                at, start = at + len(own), stop
            granule = end
            if k == len(packets) - 1:
                out.append((going_on, granule, bytes(lacing), b"".join(body)))
        done = []
        for i, (going_on, granule, lacing, body) in enumerate(out):
            flags = going_on | (2 if first and not i else 0) | (4 if last and i == len(out) - 1 else 0)
            done.append(_page(flags, granule, self.serial, self.number, lacing, body))
            self.number += 1
        return done


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an Ogg stream of 8-bit samples, multiplexed with a stream of checks."""
    samples, checks = LogicalStream(SAMPLES), LogicalStream(CHECKS)
    packets = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    head = samples.pages([(b"\x01samples8" + struct.pack("<IQ", RATE, n_bytes), 0)], first=True)
    body = samples.pages(packets, last=True)
    return b"".join([*head, *checks.pages([(b"\x01checks", 0)], first=True), *body, *checks.pages([(struct.pack("<QI", len(payload), zlib.crc32(payload)), len(payload))], last=True)])


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets by serial number, each with the granule position of its page if it is the last to end there."""
    view, at = memoryview(media), 0
    found: dict[int, list] = {}
    open_: dict[int, list] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("a page is cut off")
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError("not an Ogg page")
        lacing = media[at + 27 : at + 27 + n]
        start = at + 27 + n
        stop = start + sum(lacing)
        if len(lacing) < n or stop > len(media):
            raise ValueError("a page is cut off")
        if checksum(b"".join([view[at : at + 22], b"\0\0\0\0", view[at + 26 : stop]])) != crc:
            raise ValueError("a page's checksum is wrong")
        if number != numbers.get(serial, -1) + 1 or bool(flags & 2) != (serial not in numbers) or serial in ended:
            raise ValueError("a page is missing or out of order")
        if bool(flags & 1) != bool(open_.get(serial)):
            raise ValueError("a packet doesn't go on as its page says")
        numbers[serial] = number
        packets, own = found.setdefault(serial, []), open_.setdefault(serial, [])
        for value in lacing:
            own.append(view[start : start + value])
            start += value
            if value < 255:
                packets.append((b"".join(own), None))
                own.clear()
        if granule != -1 and packets:
            packets[-1] = (packets[-1][0], granule)
        if flags & 4:
            ended.add(serial)
        at = stop
    if ended != set(numbers) or any(open_.values()):
        raise ValueError("a stream doesn't end")
    return found


def decode(media: bytes) -> tuple[bytes, int, list[float]]:
    """The payload, its unpadded length, and the time in seconds at which each packet of samples ends."""
    streams = demultiplex(media)
    (head, _), *packets = streams[SAMPLES]
    rate, n_bytes = struct.unpack("<IQ", head[9:])
    payload = b"".join(p for p, _ in packets)
    size, crc = struct.unpack("<QI", streams[CHECKS][1][0])
    if size != len(payload) or crc != zlib.crc32(payload):
        raise ValueError("the samples don't agree with their checks")
    times, after = [0.0] * len(packets), 0
    for i in range(len(packets) - 1, -1, -1):  # back from the last packet that a granule position is for
        packet, granule = packets[i]
        end = granule if granule is not None else after
        times[i], after = end / rate, end - len(packet)
    if after:
        raise ValueError("granule positions don't agree with the packets")
    return payload, n_bytes, times


def feature(payload: bytes, times: list[float]) -> str:
    """Figures of the samples, centred at 128: duration, packets, mean, root mean square, zero crossings, peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"duration_s={times[-1]:.6f};packets={len(times)};mean={x.sum() / len(x):.6f};rms={(int(x @ x) / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def media_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            media = [encode(t + b"\0" * (-len(t) % ALIGN if t else ALIGN), len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def features_of(media: DataFrame) -> DataFrame:
    """What the stored bytes give when they are read: one row for each row of media."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                stored = x.as_py()
                payload, n_bytes, times = decode(stored)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, times)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, schema)


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(saved(media_of(documents(spark, sf_dir)), "media"))
