"""The words of whole Arrow batches of texts, found and hashed with numpy on their bytes.

No Python object is made for a word. Words are runs of bytes other than the six of ASCII white space; their hashes
take A-Z as a-z. A hash is a polynomial of a word's bytes modulo 2^64, from running sums, and then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; running sums are eight times that.
SLICE = 1 << 16
#: Odd multiplier of the polynomials.
TIMES = 0x9E3779B97F4A7C15
BACK = pow(TIMES, -1, 1 << 64)

_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW, _LOW_BACK = _powers(TIMES, SLICE), _powers(BACK, SLICE)


def _high(base: int, most: int) -> np.ndarray:
    return _powers(pow(base, SLICE, 1 << 64), most // SLICE + 1)


def _back(at: np.ndarray) -> np.ndarray:
    """The inverse of TIMES ** at modulo 2^64."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return _high(BACK, int(at.max()))[at >> 16] * _LOW_BACK[at & 0xFFFF]


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of the hashes depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    texts: np.ndarray  # first byte of each text, and the number of all
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte past its last
    edges: np.ndarray  # first word of each text, and the number of all

    def text(self, k: int) -> bytes:
        return self.data[self.texts[k] : self.texts[k + 1]].tobytes()


def words_of(column: pa.Array) -> Words:
    """The words of an array of texts (string or binary); a null has none."""
    column = column.cast(pa.large_binary())
    n = len(column)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if n and raw[2] is not None else np.zeros(0, np.uint8)
    texts = offsets - offsets[0]
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = texts[(texts > 0) & (texts < len(data))]  # a text's end is a word's end
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, texts, starts, ends, np.searchsorted(starts, texts))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each stretch of bytes; starts and ends must both ascend."""
    before, at_start, at_end = np.uint64(0), np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    high = _high(TIMES, len(data))
    for k, a in enumerate(range(0, len(data), SLICE)):
        part = data[a : a + SLICE]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _LOW[: len(part)], dtype=np.uint64, out=sums[1:])
        sums *= high[k]
        sums += before
        for want, out in ((starts, at_start), (ends, at_end)):
            i, j = np.searchsorted(want, [a, a + len(part)])
            out[i:j] = sums[want[i:j] - a]
        before = sums[-1]
    at_start[starts >= len(data)] = before
    at_end[ends >= len(data)] = before
    return mixed((at_end - at_start) * _back(starts) + (ends - starts).astype(np.uint64))


def hashes(w: Words) -> np.ndarray:
    return byte_hashes(w.data, w.starts, w.ends)


class Sequence:
    """Running sums over the words' hashes, from which any run of words gets its hash at once."""

    def __init__(self, own: np.ndarray):
        self.sums = np.zeros(len(own) + 1, np.uint64)
        high = _high(TIMES, len(own))
        for k, a in enumerate(range(0, len(own), SLICE)):
            part = own[a : a + SLICE]
            np.cumsum(part * _LOW[: len(part)], dtype=np.uint64, out=self.sums[a + 1 : a + 1 + len(part)])
            self.sums[a + 1 : a + 1 + len(part)] *= high[k]
            self.sums[a + 1 : a + 1 + len(part)] += self.sums[a]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start .. end - 1."""
        return mixed((self.sums[end] - self.sums[start]) * _back(start) + (end - start).astype(np.uint64))
