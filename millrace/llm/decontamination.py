"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

For every benchmark item of w words, each window of w words of a document has a 64-bit
SimHash of its words; a document of fewer words is one window. The fingerprints are cut into radius + 1 blocks; two within the
radius agree on a block, so the tables of the blocks, keyed by their value, yield all of
them. A candidate counts only if its weighted similarity (bags of five-word shingles, sum
of minima over sum of maxima) reaches the threshold.

The longer the item, the fewer bits differ at the same similarity, so the radius goes by
its length (``radius_of``): at the threshold it holds 99 % or more of the pairs that pass
the exact check, by measurement in the tests, and with it a quarter to a half of unrelated
fingerprints meet in a block. A document shorter than the item differs in more bits
(``SHORT_RADIUS``); it is one window, compared with all items of that length.

A window can only pass that check if it holds a shingle of the item, so fingerprints of
a length are made where a document has a shingle of an item of that length, at every
position whose window reaches it. That leaves the result as it is and spares the rest
of the corpus.

Case, white space and ASCII punctuation don't matter: words are runs of other bytes.
The benchmark goes to the workers in blocks of bounded size, one pass over the
documents for each block; there is no shuffle.

Defined results: null and empty texts are clean; items that are null or have fewer
words than a shingle match nothing; items of one text are all reported; repeated rows
are judged each; empty tables give no hit; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, slices, small_batches, text_of, utf8
from millrace.llm.hashing import HashTable, mix, windows, words

SHINGLE, PERCENT, SHORT_RADIUS, BITS = 5, 75, 22, 64
#: Bytes of benchmark text that the workers hold at once.
BLOCK_BYTES = 8 << 20
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, n + 1 bounds): the words of each text."""
    h, starts, _ = words(_BLANK[data], offsets)
    return h, np.searchsorted(starts, offsets)


def simhash(h: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` words: bits of the sums of their words' signs."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    signs = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs, 0)])
    bits = sums[size:] - sums[: len(h) - size + 1] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = int(np.minimum(na[i], nb[j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


def radius_of(w: int) -> int:
    """In how many bits a window of w words may differ from an item it is compared with."""
    return 14 if w < 20 else 13 if w < 40 else 11


class HammingIndex:
    """All stored fingerprints within ``radius`` of a query: radius + 1 blocks, each with the
    stored numbers in the order of their value in it."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.tables = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            shift, mask = np.uint64(lo), np.uint64((1 << (int(hi) - int(lo))) - 1)
            value = (prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.tables.append((shift, mask, value[order], order))

    def meet(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, stored number) of the pairs that agree on a block, each once."""
        found = []
        for shift, mask, value, order in self.tables:
            own = (query >> shift) & mask
            first = np.searchsorted(value, own)
            many = np.searchsorted(value, own, "right") - first
            turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.repeat(np.arange(len(query)), many) * len(self.prints) + order[np.repeat(first, many) + turn])
        return np.divmod(np.unique(np.concatenate(found)), max(len(self.prints), 1))

    def near(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, stored number) of all pairs within the radius."""
        q, s = self.meet(query)
        close = np.bitwise_count(query[q] ^ self.prints[s]) <= self.radius
        return q[close], s[close]

    def within(self, one: np.uint64, radius: int) -> np.ndarray:
        """The stored numbers within another radius of one fingerprint."""
        return np.flatnonzero(np.bitwise_count(self.prints ^ one) <= radius)


class Benchmark:
    """A block of items: their shingles, and an index of fingerprints for each item length."""

    def __init__(self, ids: list, texts: list[str], shingle: int = SHINGLE, percent: int = PERCENT, radius: int | None = None):
        self.shingle, self.percent = shingle, percent
        raw = [t.encode() for t in texts]
        h, at = plain_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        own = [h[at[k] : at[k + 1]] for k in range(len(raw))]
        held = [k for k in range(len(raw)) if len(own[k]) >= shingle]
        self.ids = [ids[k] for k in held]
        self.bags = [windows(own[k], shingle) for k in held]
        size = np.array([len(own[k]) for k in held], np.int64)
        self.by_size = {}
        for w in np.unique(size):
            mine = np.flatnonzero(size == w)
            self.by_size[int(w)] = (mine, HammingIndex(np.array([simhash(own[held[k]], int(w))[0] for k in mine], np.uint64), radius_of(int(w)) if radius is None else radius))
        self.size, self.known = size, HashTable()
        # for each shingle the items that hold it, end to end
        held_by = [(g, np.full(len(g), k)) for k, bag in enumerate(self.bags) for g in [np.unique(bag)]]
        if held_by:
            g, k = (np.concatenate(x) for x in zip(*held_by, strict=True))
            order = np.lexsort((k, g))
            every, self.first, self.many = np.unique(g[order], return_index=True, return_counts=True)
            self.holders = k[order]
            self.known.add(every, np.arange(len(every)))

    def _seeds(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every shingle of a text that an item holds."""
        found = self.known.find(g)
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return at, at
        n = self.many[found[at]]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.holders[np.repeat(self.first[found[at]], n) + turn]

    def near(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of some texts, end to end, may hold a shingle of an item; all are looked up at once."""
        n = np.zeros(len(h) + 1, np.int64)
        if len(h) >= self.shingle:
            n[1 : len(h) - self.shingle + 2] = self.known.find(windows(h, self.shingle)) >= 0
        total = np.cumsum(n)
        return total[at[1:]] > total[at[:-1]]

    def hits(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """By item number the best window of a text: (similarity, first word, Hamming distance)."""
        g = windows(h, self.shingle)
        out: dict[int, tuple[float, int, int]] = {}
        places, holders = self._seeds(g)
        for w in np.unique(self.size[holders]).tolist() if len(places) else ():
            items, index = self.by_size[w]
            span = min(w, len(h))  # a shorter text is one window
            seeds = np.unique(places[self.size[holders] == w])
            reach = np.zeros(len(h) - span + 2, np.int64)  # starts whose window holds a seed
            np.add.at(reach, np.clip(seeds - (span - self.shingle), 0, len(reach) - 1), 1)
            np.add.at(reach, np.minimum(seeds + 1, len(reach) - 1), -1)
            starts = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for lo in range(0, len(run), 4096):
                    part = run[lo : lo + 4096]
                    prints = simhash(h[part[0] : part[-1] + span], span)
                    if span < w:
                        s = index.within(prints[0], SHORT_RADIUS)
                        pairs = (np.zeros_like(s), s)
                    else:
                        pairs = index.near(prints)
                    for q, s in zip(*pairs, strict=True):
                        at, item = int(part[q]), int(items[s])
                        sim = similarity(g[at : at + span - self.shingle + 1], self.bags[item])
                        if 100 * sim >= self.percent - 1e-9 and (item not in out or sim > out[item][0]):
                            out[item] = (sim, at, int(np.bitwise_count(prints[q] ^ index.prints[s])))
        return out


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of about ``most`` bytes, by a hash of the item."""
    use = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("t"))
    total = use.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        rows = use.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).collect()
        yield [r["id"] for r in rows], [r["t"] for r in rows]


def scan(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), percent: int = PERCENT, radius: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, *keep, hits array<struct<item, similarity, start, n_words, distance>>) of every row;
    ``start`` counts words. With ``text`` in keep the text goes along."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema[item_id].dataType.simpleString()
    shape = f"array<struct<item:{kind},similarity:double,start:long,n_words:long,distance:int>>"
    now = docs.select(F.col(id).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)], text_of(text).alias("t"), F.lit(None).cast(shape).alias("hits"))
    for ids, texts in _blocks(items, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*sent.value, percent=percent, radius=radius)
            size = {int(item): w for w, (items, _) in bench.by_size.items() for item in items}
            for batch in batches:
                data, offsets = utf8(batch.column("t"))
                found: list[list | None] = []
                for lo, hi, d, o in slices(data, offsets):
                    h, at = plain_words(d, o)
                    some = bench.near(h, at)
                    for k in range(hi - lo):
                        best = bench.hits(h[at[k] : at[k + 1]]) if some[k] else {}
                        found.append([{"item": bench.ids[i], "similarity": s, "start": a, "n_words": min(size[i], int(at[k + 1] - at[k])), "distance": b} for i, (s, a, b) in best.items()])
                before = batch.column("hits")
                if before.null_count < len(before):
                    found = [(x or []) + y for x, y in zip(before.to_pylist(), found, strict=True)]
                at = batch.schema.get_field_index("hits")
                yield batch.set_column(at, batch.schema.field(at), pa.array(found, before.type))

        now = now.transform(in_arrow, run, now.schema)
    return now.select(F.col("k0").alias(id), *[F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)], "hits")
