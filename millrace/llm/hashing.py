"""Vectorised 64-bit hashing of words and shingles over UTF-8 bytes, and a hash table of arrays."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random odd value for each byte; what separates tokens adds nothing.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd constant, as far as the longest token needs them."""
    global _power
    if len(_power) < n:
        grown = np.full(max(n, 2 * len(_power), 64), _ODD, np.uint64)
        grown[0] = 1
        _power = np.multiply.accumulate(grown)
    return _power


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = data if total == len(data) else data[pos + np.repeat(starts, lens)]
    value = BYTE[at]
    value *= _powers(int(lens.max()))[pos]
    out = mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _M1)
    out[out == 0] = 1  # 0 marks a free place of a HashTable
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: hashes of their bytes (with ``fold``,
    A-Z in lower case), starts and ends. A word never spans two texts. Long texts go in pieces cut at white space."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~WHITE[data]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    hashes, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), "right")))
        part = data[starts[lo] : ends[hi - 1]]
        part = LOWER[part] if fold else part
        hashes.append(span_hashes(part, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]))
        lo = hi
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), starts, ends


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words, in order."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    p = _powers(size + 1)
    out = h[:n] * p[1]
    for k in range(1, size):
        out += h[k : k + n] * p[k + 1]
    return mix(out + np.uint64(size))


class HashTable:
    """Open addressing over uint64 keys; both lookup and insertion take whole arrays."""

    def __init__(self, capacity: int = 1 << 16):
        self.keys, self.value, self.n = np.zeros(capacity, np.uint64), np.zeros(capacity, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none. Keys are not 0."""
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == h, self.value[at], -1)
        todo = np.flatnonzero((seen != h) & (seen != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            seen = self.keys[at[todo]]
            hit = seen == h[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not yet there."""
        if 2 * (self.n + len(h)) > len(self.keys):
            size = len(self.keys)
            while 2 * (self.n + len(h)) > size:
                size *= 2
            used = self.keys != 0
            k, v = self.keys[used], self.value[used]
            self.keys, self.value, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int64), 0
            self.add(k, v)
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]
            won = self.keys[at[todo]] == h[todo]
            self.value[at[todo[won]]] = value[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & mask
        self.n += len(h)
