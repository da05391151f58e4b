"""Headers of DICOM files (explicit values, little-endian): the elements before the pixels, without other packages.

Format facts: 128 bytes, "DICM", then elements of group, element (16 bits each), two letters of kind, and a length of 16 bits,
or for the long kinds two zero bytes and a length of 32 bits. Sequences of undefined length end the reading.
"""

from __future__ import annotations

import struct

_LONG = {b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"}
#: The tags that tell participant, study, series and instance.
TAGS = {"participant": (0x0010, 0x0020), "study": (0x0020, 0x000D), "series": (0x0020, 0x000E), "instance": (0x0020, 0x0013), "modality": (0x0008, 0x0060), "thickness": (0x0018, 0x0050)}


def element(tag: tuple[int, int], kind: str, value: str) -> bytes:
    data = value.encode()
    data += b" " * (len(data) % 2)
    return struct.pack("<HH2sH", *tag, kind.encode(), len(data)) + data


def header(values: dict[str, str]) -> bytes:
    """A file with these elements alone, in the order of their tags."""
    kinds = {"participant": "LO", "study": "UI", "series": "UI", "instance": "IS", "modality": "CS", "thickness": "DS"}
    return b"\0" * 128 + b"DICM" + b"".join(element(tag, kinds[name], values[name]) for name, tag in sorted(TAGS.items(), key=lambda x: x[1]) if name in values)


def read_header(content: bytes) -> dict[str, str] | None:
    """The known elements of a file; None if it isn't one."""
    if content[128:132] != b"DICM":
        return None
    names = {tag: name for name, tag in TAGS.items()}
    out: dict[str, str] = {}
    at = 132
    while at + 8 <= len(content):
        group, number, kind, size = struct.unpack_from("<HH2sH", content, at)
        at += 8
        if kind in _LONG:
            if at + 4 > len(content):
                break
            (size,) = struct.unpack_from("<I", content, at)
            at += 4
        if group >= 0x7FE0 or size == 0xFFFFFFFF or at + size > len(content):
            break
        if (group, number) in names:
            out[names[group, number]] = content[at : at + size].decode("utf-8", "replace").strip(" \0")
        at += size
    return out
