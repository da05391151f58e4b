"""Vectorised work on the UTF-8 bytes of a batch of texts: words, chunks and their 64-bit hashes.

Every function takes whole texts and works in slices, so that the temporaries stay a few MB whatever
the batch holds. A hash is a polynomial over the bytes modulo 2**64, finished with a mixer; two
different words of a corpus of 10**7 distinct ones collide with a probability of about 3e-6.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n at least."""
    if len(_tables.get("pow", ())) < n:
        size = max(n, 2 * _SLICE)
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] for ascending, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(int(np.searchsorted(ends, begin + _SLICE, "right")), first + 1)
        stop = int(ends[last - 1])
        power, inverse = powers(stop - begin + 1)
        sums = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum((data[begin:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - begin], out=sums[1:])
        a, b = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        first = last
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of the texts with A-Z in lower case.

    Returns the joined bytes, the words' starts and ends in them, their hashes, and for each text the
    number of words before it (one more entry at the end).
    """
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, begin)


def batches(texts: list[bytes], most: int = 1 << 21):
    """(first, last) of runs of texts with about that many bytes; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
