"""Byte-pair merges learned from counted words.

The cluster counts words; here a word appears once, with its count as its weight. All
words lie end to end in arrays of symbols, and every step works on the places of one pair at
once: an index has the places of each pair, a heap the pairs by weight. Heap entries are not
updated when a weight falls; one that comes up with an old weight goes back with the new one.
Time and memory go with the letters of the distinct words, not with how often words occur.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHIFT = 32


def _groups(keys: np.ndarray, places: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(key, weight, places) of each key; places keep their order. Keys under 65,536 are sorted by radix."""
    if not len(keys):
        return []
    by = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
    keys, places, weight = keys[by], places[by], weight[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = [*first[1:].tolist(), len(keys)]
    return [(k, w, places[lo:hi]) for k, w, lo, hi in zip(keys[first].tolist(), np.add.reduceat(weight, first).tolist(), first.tolist(), ends, strict=True)]


def _sums(keys: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """(key, weight) of each key."""
    total = np.bincount(keys, weight)  # sums under 2^53 are exact
    some = np.flatnonzero(total)
    return list(zip(some.tolist(), total[some].astype(np.int64).tolist(), strict=True))


class Symbols:
    """Words as linked symbols: at each place a symbol (-1: merged away), the places beside it
    (-1: the word's edge) and the number of its word: 16 bytes a letter."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        n = len(letters)
        if n >= 1 << 31:
            raise ValueError("the distinct words have 2^31 letters or more")
        self.symbol = letters
        self.word, self.count = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), weights.astype(np.int64)
        at = np.arange(n, dtype=np.int32)
        ends = np.cumsum(sizes)
        self.after, self.before = at + 1, at - 1
        self.after[ends - 1] = -1
        self.before[ends - sizes] = -1

    def copy(self) -> Symbols:
        """One whose symbols can be merged without this one."""
        other = object.__new__(Symbols)
        other.word, other.count = self.word, self.count
        other.symbol, other.after, other.before = self.symbol.copy(), self.after.copy(), self.before.copy()
        return other

    def weight(self, places: np.ndarray) -> np.ndarray:
        """The counts of the words of these places."""
        return self.count[self.word[places]]

    def pairs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(pair, weight, places) of all pairs; those of one first symbol at a time."""
        begins = np.flatnonzero(self.after >= 0).astype(np.int32)
        first = self.symbol[begins]
        begins = begins[np.argsort(first.astype(np.uint16) if len(first) and first.max() < 1 << 16 else first, kind="stable")]
        edges = np.flatnonzero(np.diff(self.symbol[begins], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(begins)], strict=True):
            own = begins[lo:hi]
            for y, w, at in _groups(self.symbol[self.after[own]], own, self.weight(own)):
                yield int(self.symbol[own[0]]) << SHIFT | y, w, at

    def merge(self, a: int, b: int, new: int, places: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
        """Puts ``new`` for a and b wherever they still follow each other at ``places``, from the left. Returns the
        pairs that went with their weights, and those that came with their weights and places."""
        places = places[self.symbol[places] == a]
        second = self.after[places]
        both = (second >= 0) & (self.symbol[second] == b)
        places, second = places[both], second[both]
        if a == b and len(places):  # of a run of one symbol every other place
            opens = np.concatenate([[True], second[:-1] != places[1:]])
            first = np.maximum.accumulate(np.where(opens, np.arange(len(places)), 0))
            use = (np.arange(len(places)) - first) % 2 == 0
            places, second = places[use], second[use]
        weight = self.weight(places)
        left, right = self.before[places], self.after[second]
        inner = right >= 0
        right_was = self.symbol[right[inner]]
        self.symbol[places], self.symbol[second] = new, -1
        self.after[places] = right
        self.before[right[inner]] = places[inner]
        outer = (left >= 0) & (self.symbol[left] >= 0)  # else what is on the left was merged too: it has the pair
        left_is = self.symbol[left[outer]]
        gone = [(x << SHIFT | a, w) for x, w in _sums(left_is, weight[outer])] + [(b << SHIFT | y, w) for y, w in _sums(right_was, weight[inner])]
        came = {x << SHIFT | new: (w, at) for x, w, at in _groups(left_is, left[outer], weight[outer])}
        for y, w, at in _groups(self.symbol[right[inner]], places[inner], weight[inner]):
            pair = new << SHIFT | y
            if pair in came:  # new beside new, where its name was there before
                w, at = w + came[pair][0], np.sort(np.concatenate([at, came[pair][1]]))
            came[pair] = (w, at)
        return gone, [(pair, *x) for pair, x in came.items()]


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, end to end, and their numbers; no word becomes an object."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = words.buffers()
    o = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else [0, 0]
    text = data.slice(int(o[0]), int(o[-1]) - int(o[0])).to_pybytes().decode() if data is not None and int(o[-1]) > int(o[0]) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), sizes


def learn(words: list[str] | pa.Array | pa.ChunkedArray, counts: np.ndarray, vocab_size: int, min_frequency: int = 2, specials: tuple[str, ...] = ()) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) of distinct words and their counts.

    Ids: the specials, all letters by code point, then a symbol for each merge, until there are
    ``vocab_size`` or no pair has ``min_frequency`` occurrences. The most frequent pair
    is merged; of equals that of the smaller ids.
    """
    vocab = {s: k for k, s in enumerate(specials)}
    names = list(specials)
    column = pa.array(words, pa.large_string()) if isinstance(words, list) else words
    points, sizes = letters_of(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    ids = np.zeros(0x110000, np.int32)
    for point in np.flatnonzero(seen).tolist():
        letter = chr(point)
        if letter not in vocab:
            vocab[letter] = len(names)
            names.append(letter)
        ids[point] = vocab[letter]
    merges: list[tuple[str, str]] = []
    if not len(points):
        return vocab, merges
    text = Symbols(ids[points], sizes[sizes > 0], np.asarray(counts)[sizes > 0])
    del points
    weight: dict[int, int] = {}
    heap: list[tuple[int, int, int]] = []
    index: list[np.ndarray] = []

    def put(pair: int, places: np.ndarray) -> None:
        heapq.heappush(heap, (-weight[pair], pair, len(index)))
        index.append(places)

    for pair, n, places in text.pairs():
        weight[pair] = n
        put(pair, places)
    while heap and len(names) < vocab_size:
        n, pair, k = heap[0]
        if -n != weight[pair]:
            heapq.heapreplace(heap, (-weight[pair], pair, k))
            continue
        if -n < max(1, min_frequency):
            break
        heapq.heappop(heap)
        a, b = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
        name = names[a] + names[b]
        if name not in vocab:
            vocab[name] = len(names)
            names.append(name)
        merges.append((names[a], names[b]))
        gone, came = text.merge(a, b, vocab[name], index[k])
        index[k] = index[k][:0]
        for other, less in gone:
            weight[other] -= less
        for other, more, places in came:
            weight[other] = weight.get(other, 0) + more
            put(other, places)
    return vocab, merges
