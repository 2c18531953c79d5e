"""Token counts: pieces are counted once per distinct pre-token and joined to what each document holds.

Defined results: a null text is empty and counts 0; repeated rows and repeated ids each
keep a row of their own; an empty table gives an empty result; other columns, whatever
their names, are not read. Texts that hold a special token's string count it as one
token, as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, slices, small_batches, text_of, utf8
from millrace.llm.hashing import HashTable, span_hashes
from millrace.llm.pretoken import Splitter, of_parts

#: Pre-tokens that a task gathers before it hands them on.
GATHER = 1_000_000


def _found(splitter: Splitter, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """All pre-tokens of some texts: (bytes, starts, ends, hashes, text number, specials by text)."""
    d, starts, ends, plain = splitter.spans(data, offsets)
    h = span_hashes(d, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    special = np.zeros(len(offsets) - 1, np.int64)
    rare: list[bytes] = []
    rare_row: list[int] = []
    for k in np.flatnonzero(~plain):
        for p in splitter.parts(data[offsets[k] : offsets[k + 1]].tobytes().decode()):
            if isinstance(p, int):
                special[k] += 1
            else:
                rare.append(p)
                rare_row.append(k)
    if rare:
        more, s, e, g = of_parts(rare)
        d, starts, ends = np.concatenate([d, more]), np.concatenate([starts, s + len(d)]), np.concatenate([ends, e + len(d)])
        h, row = np.concatenate([h, g]), np.concatenate([row, np.array(rare_row, np.int64)])
    return d, starts, ends, h, row, special


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())])


def distinct_pretokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre binary, freq long): every distinct pre-token of the whole texts, and how often it occurs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        table, freq, parts, n = HashTable(), np.zeros(GATHER, np.int64), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(parts), pa.array(freq[:n])], ["pre", "freq"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                d, starts, ends, h, _, _ = _found(splitter, d, o)
                u, first, count = np.unique(h, return_index=True, return_counts=True)
                at = table.find(u)
                new = at < 0
                if n + new.sum() > len(freq):
                    if n:
                        yield out()
                    table, parts, n = HashTable(), [], 0
                    freq = np.zeros(max(GATHER, len(u)), np.int64)
                    at, new = np.full(len(u), -1), np.ones(len(u), bool)
                if new.any():
                    at[new] = n + np.arange(new.sum())
                    table.add(u[new], at[new])
                    parts.append(_binary(d, starts[first[new]], ends[first[new]]))
                    n += int(new.sum())
                freq[at] += count
        if n:
            yield out()

    found = docs.select(text_of(text).alias("text")).transform(in_arrow, gather, "pre binary, freq long")
    return found.groupBy("pre").agg(F.sum("freq").alias("freq"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds n_pieces, counted by the library once for each row, and the hash h."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        for batch in batches:
            pre = batch.column("pre").to_pylist()
            _, _, _, h = of_parts(pre)
            n = [len(splitter.ids(p)) for p in pre]
            yield pa.RecordBatch.from_arrays([batch.column("pre"), batch.column("freq"), pa.array(n, pa.int32()), pa.array(h.view(np.int64))], ["pre", "freq", "n_pieces", "h"])

    return pretokens.select("pre", "freq").transform(in_arrow, count, "pre binary, freq long, n_pieces int, h long")


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: those from the lowest class of frequency on that lets all above it in.

    Classes are sixteenths of a power of two, so their histogram has under a thousand
    rows, whatever the corpus; a sort with a limit would send ``most`` rows of every task.
    """
    of = F.floor(F.log2("freq") * 16)
    held = 0
    least = None
    for r in counted.groupBy(of.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    return counted.filter(F.lit(False) if least is None else of >= least)


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", head: int = 131_072) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row.

    The piece counts of the ``head`` most frequent pre-tokens, a table of that bounded
    size, go to all workers and are summed where a text is read; every other pre-token
    joins its count by a shuffle, with its frequency in the document. No ids are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counted = materialize(piece_counts(distinct_pretokens(docs, path, text), path), "pieces")
    top = _most_frequent(counted, head).select("h", "n_pieces").toPandas()
    sent = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64).view(np.uint64), top["n_pieces"].to_numpy(np.int64)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, common = Splitter(path), HashTable()
        common.add(*sent.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi, d, o in slices(data, offsets):
                d, starts, ends, h, row, special = _found(splitter, d, o)
                n = common.find(h)
                held = np.bincount(row, np.maximum(n, 0), hi - lo).astype(np.int64) + special
                tail = np.flatnonzero(n < 0)
                key = np.lexsort((h[tail], row[tail]))
                tail = tail[key]
                new = np.ones(len(tail), bool)
                new[1:] = (h[tail][1:] != h[tail][:-1]) | (row[tail][1:] != row[tail][:-1])
                at = np.flatnonzero(new)
                freq = np.diff(np.append(at, len(tail)))
                tail = tail[at]
                rows = np.concatenate([np.arange(hi - lo), row[tail]]) + lo
                pre = pa.concat_arrays([pa.nulls(hi - lo, pa.binary()), _binary(d, starts[tail], ends[tail])])
                take = pa.array(rows)
                bytes_ = np.concatenate([np.diff(o), np.zeros(len(tail), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("fp").take(take), pre, pa.array(np.concatenate([held, freq])), pa.array(bytes_)],
                    ["id", "fp", "pre", "n", "n_bytes"],
                )

    kind = docs.schema[id].dataType.simpleString()
    source = docs.select(F.col(id).alias("id"), F.xxhash64(text_of(text)).alias("fp"), text_of(text).alias("text"))
    rows = source.transform(in_arrow, frequencies, f"id {kind}, fp long, pre binary, n long, n_bytes long")
    known = counted.select(F.col("pre").alias("p"), "n_pieces")
    # a row's own count has no pre-token: it goes along under a key that no UTF-8 holds, dealt by the text's hash
    own = F.col("pre").isNull()
    key = F.coalesce("pre", F.concat(F.lit(b"\xff"), F.col("fp").cast("string").cast("binary")))
    rows = rows.withColumns({"own": own, "key": key}).drop("pre")
    joined = rows.join(known, F.col("key") == F.col("p"), "left")
    n = F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("n_pieces"))
    total = joined.groupBy("id", "fp").agg(F.sum(n).alias("n"), F.max("n_bytes").alias("n_bytes"), F.count_if("own").alias("copies"))
    # equal rows meet in one group: each of them gets its share back
    each = total.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(F.col("id").alias(id), "n_bytes", F.expr("n div copies").alias("n_tokens"))
