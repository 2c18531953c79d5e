"""Best-fit packing: best-fit decreasing over a segment tree of remaining capacities.

Bins of one remaining capacity are alike, and so are pieces of one length. So the tree
has a leaf for each capacity, and one step places a run of equal pieces into a run of
equal bins, just where best-fit decreasing would put them one by one. The driver sees
the histogram of lengths (at most ``limit`` rows) and emits a plan of runs; the pieces
themselves find their places in it by their rank within their length.

Defined results: a null text is empty and yields the end id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, slices, small_batches, text_of, utf8
from millrace.llm.hashing import span_hashes
from millrace.llm.pretoken import Splitter, Vocabulary


#: Runs of a plan that are broadcast with their lengths: about 40 bytes each.
MOST_RUNS = 300_000


class CapacityTree:
    """A segment tree over capacities 0 to limit; a node tells whether any bin lies below it."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open bin that is not under ``need``, else -1."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts by length: rows (length, first rank, end rank, first
    sequence, pieces to a bin, offset). Within a row, the j-th piece lies in sequence
    first + j div per, at offset + (j mod per) * length."""
    tree, bins = CapacityTree(limit), {}
    rows, opened = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n:
            bins.setdefault(capacity, deque()).append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                per = limit // length
                room, first, n = limit, opened, -(-left // per)
                opened += n
            else:
                first, n = bins[room].popleft()
                tree.add(room, -n)
                per = room // length
            take = min(left, n * per)
            full, rest = divmod(take, per)
            rows.append((length, rank, rank + take, first, per, limit - room))
            put(room - per * length, first, full)
            put(room - rest * length, first + full, 1 if rest else 0)
            put(room, first + full + (rest > 0), n - full - (rest > 0))
            left, rank = left - take, rank + take
    return rows


def pieces(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than ``limit``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        known = Vocabulary(splitter)
        end = np.array([end_id], np.int32)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows, piece, start, length, crc = [], [], [], [], []
            for lo, hi, d, o in slices(data, offsets):
                low, s, e, plain = splitter.spans(d, o)
                ids, size = known.gather(known.index(span_hashes(low, s, e), low, s, e))
                ends = np.concatenate([[0], np.cumsum(size)])
                at = ends[np.searchsorted(s, o)]
                for k in range(hi - lo):
                    if plain[k]:
                        own = np.append(ids[at[k] : at[k + 1]], end)
                    else:
                        whole = d[o[k] : o[k + 1]].tobytes().decode()
                        own = np.array(splitter.tok.encode(whole, add_special_tokens=False).ids + [end_id], np.int32)
                    for p, b in enumerate(range(0, len(own), limit)):
                        part = own[b : b + limit]
                        rows.append(lo + k)
                        piece.append(p)
                        start.append(b)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), text_of(text).alias("text")).transform(in_arrow, cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, limit: int = 2048, per_bucket: int = 5_000) -> DataFrame:
    """Adds sequence_id and offset to pieces that are written down already.

    Ranks within a length come from counts of (length, hash bucket) and a row number
    within each. A length has a bucket for each ``per_bucket`` of its pieces: no task sees all pieces
    of the most frequent one, and there are hardly more counts than lengths.
    """
    spark = found.sparkSession
    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    runs: dict[int, list] = {}
    for length, lo, hi, first, per, offset in plan(sizes, limit):
        runs.setdefault(length, []).append((lo, hi, first, per, offset))
    table = spark.createDataFrame([(n, -(-sizes[n] // per_bucket), r) for n, r in runs.items()], "length long, buckets long, runs array<struct<lo:long,hi:long,first:long,per:long,base:long>>")
    share = F.broadcast(table.select("length", "buckets"))  # at most limit rows
    table = F.broadcast(table.drop("buckets")) if sum(map(len, runs.values())) <= MOST_RUNS else table.drop("buckets")
    keyed = found.join(share, "length").withColumn("bucket", F.expr("pmod(xxhash64(id, piece, ids_crc32), buckets)")).drop("buckets")
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth")).join(table, "length")
    run = placed.withColumn("run", F.expr("element_at(filter(runs, r -> rank >= r.lo AND rank < r.hi), 1)"))
    return run.select(
        "id", "piece", "start", "length", "ids_crc32",
        F.expr("run.first + (rank - run.lo) div run.per").alias("sequence_id"),
        F.expr("run.base + pmod(rank - run.lo, run.per) * length").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it."""
    found = materialize(pieces(docs, path, limit, end_id, id, text), "packed-pieces")
    return pack(found, limit).withColumnRenamed("id", id)
