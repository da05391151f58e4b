"""Token ids by the `tokenizers` library, with a bounded cache of the pieces that it has encoded.

A byte-level BPE encodes each pre-token by itself. Texts are cut at places that are certain to be
borders of pre-tokens: between a letter and ASCII punctuation or a line end, between punctuation other
than an apostrophe and a letter, and before a single space between two characters that aren't white
space. Letters are those of ASCII and U+00C0-U+00FF; near any other character no cut is made. The
library encodes each piece that the cache lacks, so the ids are those of the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.bytesvec import batches, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Classes of bytes: other, ASCII letter, punctuation or digit, apostrophe, space, line end.
_OTHER, _LETTER, _MARK, _QUOTE, _BLANK, _LINE = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 48), *range(48, 65), *range(91, 97), *range(123, 127)]] = _MARK
_CLASS[39], _CLASS[32], _CLASS[10] = _QUOTE, _BLANK, _LINE


def borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: what is certain to start a pre-token (see the module's text); letters, digits and ASCII marks."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0-U+00FF: all letters but U+00D7 and U+00F7
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    solid = (kind >= _LETTER) & (kind <= _QUOTE)
    letter, mark = kind == _LETTER, (kind == _MARK) | (kind == _QUOTE)
    digit = (data >= 48) & (data <= 57)
    cut = np.zeros(len(data), bool)
    a, b = slice(None, -1), slice(1, None)
    cut[b] |= letter[a] & mark[b]
    cut[b] |= (kind[a] == _MARK) & letter[b]
    cut[b] &= ~(digit[a] & mark[b])
    if len(data) > 2:
        lone = solid[:-2] & solid[2:]
        gap = lone & ((kind[1:-1] == _BLANK) | (kind[1:-1] == _LINE))
        cut[1:-1] |= gap
        cut[2:] |= lone & (kind[1:-1] == _LINE)
    return cut, solid


class Encoder:
    """Encodes batches of texts. Memory: 2**slot_bits slots of 16 bytes, and the pool of their ids."""

    def __init__(self, path: str, slot_bits: int = 21, pool: int = 1 << 23):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.line = self.model.encode("\n", add_special_tokens=False).ids
        self.shift = np.uint64(64 - slot_bits)
        self.slots, self.room = 1 << slot_bits, pool
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.offset = np.zeros(self.slots, np.int32)
        self.count = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(self.room, np.uint32)
        self.used = 0

    def _new(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces, by the library; plain: those without white space but for a space in front."""
        counts = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        for own in np.array_split(np.flatnonzero(plain), max(1, int(plain.sum()) // 20_000)):
            # one call for many: each ends with a line end, which is a pre-token of its own
            text = "\n".join([*(pieces[i] for i in own.tolist()), ""])
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line[0])
            if len(ends) != len(own):
                raise ValueError("pieces of text don't stand alone")
            begin = np.concatenate([[0], ends[:-1] + 1]) if len(own) else ends
            counts[own] = ends - begin
            for i, x, y in zip(own.tolist(), begin.tolist(), ends.tolist(), strict=True):
                parts[i] = ids[x:y]
        rest = np.flatnonzero(~plain).tolist()
        for i, x in zip(rest, self.model.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(x.ids, np.uint32)
            counts[i] = len(x)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), counts

    def _batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(joined, np.uint8)
        cut, solid = borders(data)
        cut[begin[:-1][begin[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        keys[keys == 0] = 1
        slot = (keys >> self.shift).astype(np.int64)
        hit = self.keys[slot] == keys
        offset, count = self.offset[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        pool = self.pool
        if len(miss):
            fresh, at, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            at = miss[at]
            a, b = starts[at], ends[at]
            inner = a + (data[a] == 32)
            loose = np.concatenate([[0], np.cumsum(~solid)])
            plain = (inner < b) & (loose[b] == loose[inner])
            ids, counts = self._new([joined[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], plain)
            places = np.cumsum(counts) - counts
            if self.used + len(ids) <= len(self.pool):
                self.pool[self.used : self.used + len(ids)] = ids
                places += self.used
                self.used += len(ids)
                own, one = np.unique(slot[at], return_index=True)
                self.keys[own], self.offset[own], self.count[own] = fresh[one], places[one], counts[one]
            else:  # the pool is full: these ids serve this batch alone, and the cache starts anew
                pool = np.concatenate([self.pool[: self.used], ids])
                places += self.used
                self.forget()
            offset[miss], count[miss] = places[back], counts[back]
        before = np.concatenate([[0], np.cumsum(count)])
        flat = np.repeat(offset - before[:-1], count) + np.arange(before[-1])
        return pool[flat], before[np.searchsorted(starts, begin)]

    def encode(self, texts: list[bytes]):
        """Yields, for runs of texts, (first text, ids of the run, offsets of its texts in them)."""
        for first, last in batches(texts):
            ids, offsets = self._batch(texts[first:last])
            yield first, ids, offsets


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
