"""Ranked lexical search of stated items over all documents, by sort-based accumulation.

Documents are read once: the terms of the items that each holds are written down with their counts. From
that table come the statistics (documents, terms, document frequencies) and the scores: the lists of
(item, document, impact) of all matched terms are concatenated, their packed keys (item, document)
radix-sorted and equal keys summed by ``reduceat``. A task keeps the best k documents of each
item in a heap. What tasks keep is dealt by ranges of (item, score), so that an item's
candidates lie in as many ranges as they need; each range keeps its best k by heaps again, and
the rest is ranked.

Items go in blocks of ``block_bytes`` of text, each of which meets all documents; a worker holds
one block's terms. Terms are told apart by 64-bit hashes.

Defined results: a null text has no terms; documents without a term do not count; items without a known term,
or whose terms all weigh 0, get no rows; each row of the items is an item of its own, repeated ids included;
documents of one id are documents of their own; a null document id stands behind all others of its score;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, slices, small_batches, text_of, utf8
from millrace.llm.hashing import LOWER, HashTable, span_hashes

TOP = 50
BLOCK_BYTES = 4 << 20
#: Term occurrences that are summed up at once.
ENTRIES = 1 << 21
#: What parts terms: all of ASCII but digits and letters.
_PARTS = np.ones(256, bool)
_PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all the texts in order, and the n + 1 places where each text's begin."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~_PARTS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    hashes, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), "right")))
        hashes.append(span_hashes(LOWER[data[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]))
        lo = hi
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


class Items:
    """A block of items: their distinct terms, and for each term the items that hold it."""

    def __init__(self, texts: list[str]):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        h, at = terms(data, offsets)
        item = np.repeat(np.arange(len(texts)), np.diff(at))
        self.hashes, number = np.unique(h, return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * (len(texts) + 1) + item)
        self.item = pairs % (len(texts) + 1)
        self.edge = np.searchsorted(pairs // (len(texts) + 1), np.arange(len(self.hashes) + 1))

    def table(self) -> HashTable:
        known = HashTable()
        known.add(self.hashes, np.arange(len(self.hashes)))
        return known


def _matched(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc, n, terms, counts): of each document with a term, how many it has, and the known ones by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashTable()
        known.add(hashes, np.arange(len(hashes)))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi, d, o in slices(data, offsets):
                h, at = terms(d, o)
                number = known.find(h)
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                pairs, counts = np.unique((row * (len(hashes) + 1) + number)[number >= 0], return_counts=True)
                some = np.flatnonzero(np.diff(at))
                edge = np.searchsorted(pairs // (len(hashes) + 1), np.append(some, hi - lo)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v)) for v in ((pairs % (len(hashes) + 1)).astype(np.int32), counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(some + lo)), pa.array(np.diff(at)[some]), *lists], ["doc", "n", "terms", "counts"])

    return in_arrow(docs, run, "doc long, n long, terms array<int>, counts array<long>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of packed keys, by their digits of 16 bits from the last on; numpy sorts such digits by radix."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Best:
    """The k best (score, document) of each item, in heaps; of equal scores the least id is best."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a score under it has no chance
        self.last = np.full(items, np.inf)  # nor has that score with an id over it

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """A document without an id counts as infinite: it is last."""
        some = np.flatnonzero((score > self.least[item]) | (score == self.least[item]) & (doc <= self.last[item]))
        for i, s, d in zip(item[some].tolist(), score[some].tolist(), doc[some].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i], self.last[i] = heap[0][0], -heap[0][1]

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [(i, s, None if d == -math.inf else -d) for i, heap in enumerate(self.heaps) for s, d in heap]
        for lo in range(0, len(rows), 1 << 16):
            columns = zip(*rows[lo : lo + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "score", "doc"])


_KEPT = "item int, score long, doc long"


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as integers; with nulls among them as Python integers, where no id is infinite."""
    if not column.null_count:
        return column.to_numpy()
    return np.array([math.inf if x is None else x for x in column.to_pylist()], object)


def _scored(matched: DataFrame, block: Items, texts: int, weight: np.ndarray, total: int, number: int, k: int) -> DataFrame:
    """The best k documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(texts, k)
        spread = np.diff(block.edge)
        for batch in batches:
            ids, n = _ids(batch.column("doc")), batch.column("n").to_numpy()
            lists, counts = batch.column("terms"), batch.column("counts")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
            m = 50 + (50 * n * number) // total
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            made = np.concatenate([[0], np.cumsum(spread[term])])[ends]  # entries before each document
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(made, made[lo] + ENTRIES, "right")) - 1)
                hi = min(hi, lo + (1 << 16), len(batch))
                part = slice(ends[lo], ends[hi])
                each = spread[term[part]]
                at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(block.edge[term[part]], each)
                key = (block.item[at].astype(np.uint64) << np.uint64(16)) | np.repeat((row[part] - lo).astype(np.uint64), each)
                order = radix_order(key)
                key, value = key[order], np.repeat(impact[part], each)[order]
                opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                score = np.add.reduceat(value, opens) if len(key) else value
                key = key[opens][score > 0]
                best.add((key >> np.uint64(16)).astype(np.int64), score[score > 0], ids[lo + (key & np.uint64(0xFFFF)).astype(np.int64)])
                lo = hi
        yield from best.batches()

    return in_arrow(matched, run, _KEPT)


def _selected(kept: DataFrame, items: int, k: int, parts: int) -> DataFrame:
    """The best k of each item in each range of (item, score, document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for batch in batches:
            best.add(batch.column("item").to_numpy().astype(np.int64), batch.column("score").to_numpy(), _ids(batch.column("doc")))
        yield from best.batches()

    dealt = kept.repartitionByRange(parts, "item", F.desc("score"), F.asc_nulls_last("doc"))
    return in_arrow(dealt, run, _KEPT)


def _blocks(items: DataFrame, id: str, text: str, most: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``most`` bytes and under 65,536 rows, by a hash."""
    use = items.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("t"))
    size = use.agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("n")).first()
    n = max(1, -(-(size["b"] or 0) // most), -(-size["n"] // 30_000))
    for k in range(n):
        rows = use.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).collect()
        if rows:
            yield [r["id"] for r in rows], [r["t"] for r in rows]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of each item, those of score 0 left out."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id).cast("long").alias("doc"), text_of(text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc")]
    out = []
    for ids, texts in _blocks(items, item_id, item_text, block_bytes):
        block = Items(texts)
        matched = materialize(_matched(plain, block.hashes), "search-matched")
        size = matched.agg(F.count("*").alias("number"), F.sum("n").alias("total")).first()
        number, total = size["number"], size["total"] or 1
        weight = np.zeros(len(block.hashes), np.int64)
        for r in matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a block's terms at most
            weight[r["term"]] = math.floor(1000 * math.log((2 * number + 2) / (2 * r["df"] + 1)))
        kept = materialize(_scored(matched, block, len(texts), weight, total, number, k), "search-kept")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        selected = _selected(kept, len(texts), k, parts)
        ranked = selected.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, {item_id} {kind}")
        found = ranked.join(F.broadcast(names), "item")  # the rows of a block
        out.append(materialize(found.select(item_id, "rank", F.col("doc").alias(id), "score"), "search-found"))
        release(matched, kept)
    if not out:
        return spark.createDataFrame([], f"{item_id} {kind}, rank int, {id} long, score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole


def oracle(k: int = TOP) -> str:
    """The result of op13 in DuckDB."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
d AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM w WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {words("text")} AS w FROM benchmark)),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // total AS m FROM d, s),
x AS (SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM o WHERE rank <= {k}
"""
