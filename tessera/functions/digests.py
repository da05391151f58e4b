"""MD5 of many short texts at once, for orders by hash."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACE = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class PrefixedMd5:
    """Called with a head: the digests of the head followed by each of the texts, as two arrays of numbers in the order of the digests' bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.size, self.made = texts, np.array([len(t) for t in texts], np.int64), {}

    def _words(self, start: int) -> list[int | np.ndarray]:
        """The sixteen words of the padded texts, moved by `start`; a word that all have is a number."""
        if start not in self.made:
            message = np.zeros((len(self.texts), 64), np.uint8)
            row = np.repeat(np.arange(len(self.texts)), self.size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
            message[row, start + at] = np.frombuffer(b"".join(self.texts), np.uint8)
            message[np.arange(len(self.texts)), start + self.size] = 0x80
            words = message.view("<u4").T.copy()
            words[14] = 8 * (start + self.size)
            self.made[start] = [int(w[0]) if (w == w[0]).all() else w for w in words]
        return self.made[start]

    def __call__(self, head: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(head) + int(self.size.max(initial=0)) > 55 or not len(self.texts):  # more than a block
            words = np.frombuffer(b"".join(hashlib.md5(head + t, usedforsecurity=False).digest() for t in self.texts), ">u8").reshape(-1, 2)
            return words[:, 0].astype(np.uint64), words[:, 1].astype(np.uint64)
        own = np.frombuffer(head.ljust(64, b"\0"), "<u4")
        words = [w | (int(h) if isinstance(w, int) else h) if h else w for w, h in zip(self._words(len(head)), own, strict=True)]
        a, b, c, d = (np.full(len(self.texts), v, np.uint32) for v in _START)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            kind = i // 16
            if kind == 0:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif kind == 1:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif kind == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            word, turn = words[_PLACE[kind](i)], _TURN[kind][i % 4]
            if isinstance(word, int):
                f += np.uint32((_K[i] + word) & 0xFFFFFFFF)
            else:
                f += np.uint32(_K[i])
                f += word
            np.left_shift(f, np.uint32(turn), out=g)
            f >>= np.uint32(32 - turn)
            f |= g
            f += b
            a, b, c, d, f = d, f, b, c, a
        a, b, c, d = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START, strict=True))
        return a << np.uint64(32) | b, c << np.uint64(32) | d
