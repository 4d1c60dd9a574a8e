"""One portable hash for everything random, so draws repeat on any engine and on any cluster size."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 1 << 32


def text_hash(*parts: Column) -> Column:
    """Uniform integer in 0 .. 2**32-1 from the md5 of the parts as texts, joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def portable_hash(seed, *cols) -> Column:
    """``text_hash`` of a seed and columns."""
    return text_hash(F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols])



def unit_hash(seed, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return portable_hash(seed, *cols) / F.lit(float(SPACE))


# The same hash over arrays of texts: MD5 of messages of one block, all texts of a length at a time.

_BLOCK, _CHUNK = 55, 4096
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: dict[int, np.ndarray], fixed: list[int], n: int) -> np.ndarray:
    """First 32 bits of the MD5 of one-block messages: word j of a message is ``fixed[j]`` plus ``words[j]``, where there is one."""
    out = np.empty(n, np.uint32)
    add = [np.uint32((sine + fixed[at]) & 0xFFFFFFFF) for sine, at in zip(_SINES, _PLACES)]
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        a, b, c, d = (np.full(hi - lo, x, np.uint32) for x in _START)
        f, g = np.empty_like(a), np.empty_like(a)
        part = {j: w[lo:hi] for j, w in words.items()}
        for i in range(61):  # the last three steps leave the first word alone
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f), np.add(f, add[i], out=f)
            if _PLACES[i] in part:
                np.add(f, part[_PLACES[i]], out=f)
            np.left_shift(f, np.uint32(_SHIFTS[i]), out=g), np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f), np.bitwise_or(f, g, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        np.add(b, np.uint32(_START[0]), out=out[lo:hi])
    return out.byteswap()


class TextDraws:
    """``text_hash`` of (head, name, tail) for many pairs of head and tail, known beforehand, and one name at a time."""

    def __init__(self, heads: list[bytes], tails: list[bytes], head: np.ndarray, tail: np.ndarray):
        """``head`` and ``tail``: number of the texts of each row. Rows are taken in the order of ``order`` from here on."""
        self.heads, self.tails = heads, tails
        sizes = np.array([len(x) for x in heads])[head] * 64 * 1024 + np.array([len(x) for x in tails])[tail]
        self.order = np.argsort(sizes, kind="stable")
        self.head, self.tail, sizes = head[self.order], tail[self.order], sizes[self.order]
        starts = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]])) if len(sizes) else np.zeros(0, int)
        self.classes = list(zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)]))
        self.words: dict[tuple[int, int], tuple[dict[int, np.ndarray], list[int]]] = {}

    def _template(self, start: int, stop: int, room: int) -> tuple[dict[int, np.ndarray], list[int]]:
        """Words of the rows' messages with zeros for a name of ``room`` bytes."""
        if (start, room) not in self.words:
            first, last = len(self.heads[self.head[start]]), len(self.tails[self.tail[start]])
            size = first + room + last + 2
            raw = np.zeros((stop - start, 64), np.uint8)
            for at, texts, which, width in ((0, self.heads, self.head, first), (first + room + 2, self.tails, self.tail, last)):
                used, place = np.unique(which[start:stop], return_inverse=True)
                if width:
                    raw[:, at : at + width] = np.frombuffer(b"".join(texts[i] for i in used), np.uint8).reshape(-1, width)[place]
            view = raw.view("<u4")
            own = [*range(0, (first + 3) // 4), *range((first + room + 2) // 4, (size + 3) // 4)]
            end = np.zeros(64, np.uint8)
            end[first], end[first + 1 + room], end[size] = ord("|"), ord("|"), 0x80
            fixed = end.view("<u4").astype(object)
            fixed[14] = size * 8
            self.words[start, room] = {j: np.ascontiguousarray(view[:, j]) for j in set(own)}, fixed.tolist()
        return self.words[start, room]

    def draw(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Hashes of the rows, whose numbers ascend."""
        text = name.encode()
        out = np.empty(len(rows), np.uint32)
        for start, stop in self.classes:
            s, e = np.searchsorted(rows, [start, stop])
            if s == e:
                continue
            first, last = len(self.heads[self.head[start]]), len(self.tails[self.tail[start]])
            if first + len(text) + last + 2 > _BLOCK:
                out[s:e] = [int.from_bytes(hashlib.md5(b"|".join([self.heads[self.head[i]], text, self.tails[self.tail[i]]])).digest()[:4], "big") for i in rows[s:e]]
                continue
            words, fixed = self._template(start, stop, len(text))
            whole = np.zeros(64, np.uint8)
            whole[first + 1 : first + 1 + len(text)] = np.frombuffer(text, np.uint8)
            fixed = [a + int(b) for a, b in zip(fixed, whole.view("<u4"))]
            at = rows[s:e] - start
            own = words if e - s == stop - start else {j: w[at] for j, w in words.items()}
            out[s:e] = _first_words(own, fixed, e - s)
        return out
