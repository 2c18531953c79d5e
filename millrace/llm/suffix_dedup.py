"""Removal of passages that stand earlier in the corpus, by run-length indexes of what repeats.

Every string of ``size`` bytes belongs to one anchor: the run of ``GRAM`` bytes in it with the
least hash, the leftmost of equals. Equal strings have equal anchors, and the strings of one
occurrence of an anchor are consecutive starts, so that a text falls into stretches of up to
``size - GRAM + 1`` starts, one for each occurrence. Then

1. equal stretches: all but the earliest go whole (first within a map task, then by anchor);
2. different stretches that share an anchor are cut out of the texts and meet by anchor. Their
   starts are split in those left and right of the middle, which must share the 62 bytes
   that all strings of that side hold. The stretches of such a group are indexed by a
   run-compressed Burrows-Wheeler transform (``RunIndex``) and the later ones streamed through it
   for their matching statistics: a start that matches ``size`` bytes of an earlier stretch
   is marked. In a group of m that takes log2(m) steps: at step k, of each 2^(k+1) stretches
   in order the first half is indexed and the second streamed, so that every two meet once,
   the earlier in the index. Marked strings leave both sides: their earliest copy stays.

An anchor of very many different stretches would be one task's lot. Such anchors (``hot`` or more
stretches, counted in a first pass; at most a million of them, 8 MB) have stretches of a single start,
under the hash of its own ``size`` bytes: equal ones meet, and meet no others.

Anchors and stretches are told apart by 64-bit hashes; two stretches count as equal if both agree.

Defined results: a null text is empty; rows with equal id and text are one document and get the same
result; rows with equal ids and different texts stand in the order of the CRC-32 of their texts; a row without
id comes after all others; texts under ``size`` bytes stay; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, slices, small_batches, text_of, utf8
from millrace.llm.hashing import _M1, _ODD, mix
from millrace.llm.run_index import RunIndex, flat

SIZE = 100
#: Bytes of an anchor.
GRAM = 24
#: Starts of a slice that are hashed at once; their places take the low bits of a sort key.
PIECE, PLACE_BITS = 1 << 19, 20
#: Stretches that a map task keeps before it sends them off, and of a bucket that one task gets.
KEPT, BUCKET = 1 << 20, 1 << 19
#: Bytes of stretches in one index task.
INDEX_BYTES = 4 << 20
HOT, MOST_HOT = 20_000, 1_000_000
#: What stands for a null id: it comes last.
NO_ID = (1 << 63) - 1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_pw = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _pw, _inv
    if len(_pw) < n:
        for name, base in (("_pw", int(_ODD)), ("_inv", pow(int(_ODD), -1, 1 << 64))):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            globals()[name] = np.multiply.accumulate(grown)
    return _pw, _inv


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash for each run of GRAM bytes."""
    n = len(data) - 7
    w = np.empty(n, np.uint64)
    for j in range(8):
        m = (len(data) - j) // 8
        w[j::8] = data[j : j + 8 * m].view("<u8")
    n -= GRAM - 8
    return mix(w[:n] * _A + w[8 : n + 8] * _B + w[16 : n + 16] * _C)


class Stretches:
    """Columns of stretches: the text's row, the first start, the number of starts, how far
    the anchor stands behind the first start, the anchor's hash and that of the stretch."""

    def __init__(self, *columns: np.ndarray):
        self.row, self.start, self.n, self.off, self.anchor, self.print = columns


def stretches(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, hot: np.ndarray | None = None) -> Stretches:
    """The stretches of all the texts; ``hot`` anchors (sorted) have stretches of one start."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64) for _ in range(4)] + [np.zeros(0, np.uint64) for _ in range(2)]]
    long = np.flatnonzero(np.diff(offsets) >= size)
    change = np.zeros(len(data) + 1, np.int8)  # where starts of whole strings begin and end
    change[offsets[long]] = 1
    np.add.at(change, offsets[long + 1] - size + 1, -1)
    whole = np.cumsum(change[:-1], dtype=np.int8) > 0
    width = size - GRAM + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for lo in range(0, max(0, len(data) - size + 1), PIECE):
        part = data[lo : lo + PIECE + size - 1]
        here = np.flatnonzero(whole[lo : lo + len(part) - size + 1])
        if not len(here):
            continue
        h = _grams(part)
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(h) - width + 1
        least = np.minimum(least[:n], least[width - span : width - span + n])
        place = (least[here] & mask).astype(np.int64)
        opens = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(here) != 1)])
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(here)))
        at, anchor = here[first], h[place[first]]
        off = place[first] - at
        if hot is not None and len(hot):
            k = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
            alone = hot[k] == anchor
            if alone.any():
                single = flat(at[alone], count[alone])
                at, off = np.concatenate([at[~alone], single]), np.concatenate([off[~alone], np.zeros(len(single), np.int64)])
                anchor = np.concatenate([anchor[~alone], np.zeros(len(single), np.uint64)])
                count = np.concatenate([count[~alone], np.ones(len(single), np.int64)])
        pw, inv = _powers(len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * pw[: len(h)])])
        own = mix((total[at + count + size - GRAM] - total[at]) * inv[at] + count.astype(np.uint64) * _M1)
        if hot is not None and len(hot):
            anchor = np.where(anchor == 0, mix(own), anchor)
        row = np.searchsorted(offsets, at + lo, "right") - 1
        out.append([row, at + lo - offsets[row], count, off, anchor, own])
    return Stretches(*[np.concatenate(c) for c in zip(*out, strict=True)])


#: Columns that stretches travel in, as bytes of a binary column.
KINDS = {"anchor": "<u8", "print": "<u8", "doc": "<i8", "crc": "<u4", "start": "<i8", "n": "<i8", "off": "|u1"}


def _planes(a: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: what is small compresses to next to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    k = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(k.itemsize, -1).T).reshape(-1).view(k)


def _of_batch(batch: pa.RecordBatch, size: int, hot: np.ndarray | None) -> Iterator[dict[str, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    ids = batch.column("doc").to_numpy(zero_copy_only=False)
    for lo, hi, d, o in slices(data, offsets):
        s = stretches(d, o, size, hot)
        crc = np.array([zlib.crc32(d[a:b]) if b - a >= size else 0 for a, b in zip(o, o[1:])], np.uint32)
        yield {"anchor": s.anchor, "print": s.print, "doc": ids[lo:hi][s.row], "crc": crc[s.row], "start": s.start, "n": s.n, "off": s.off.astype(np.uint8)}


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in KINDS}


def _take(t: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in t.items()}


def _classes(t: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Sorted by stretch and order of the corpus: the table, what is the first of its class,
    and what is a later copy (another occurrence than the first)."""
    t = _take(t, np.lexsort((t["start"], t["crc"], t["doc"], t["print"], t["anchor"])))
    head = np.ones(len(t["n"]), bool)
    head[1:] = (t["print"][1:] != t["print"][:-1]) | (t["anchor"][1:] != t["anchor"][:-1])
    of = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    same = (t["doc"] == t["doc"][of]) & (t["crc"] == t["crc"][of]) & (t["start"] == t["start"][of])
    return t, head, ~same


def _runs(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Marked stretches of one text that follow each other as one."""
    t = _take(t, np.lexsort((t["start"], t["crc"], t["doc"])))
    opens = np.ones(len(t["n"]), bool)
    opens[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["crc"][1:] != t["crc"][:-1]) | (t["start"][1:] != t["start"][:-1] + t["n"][:-1])
    first = np.flatnonzero(opens)
    out = _take(t, first)
    out["n"] = np.add.reduceat(t["n"], first) if len(first) else t["n"][:0]
    return out


def _counted(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, n): different stretches of an anchor in a map task where there are two or more, and
    under no anchor the task's number of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, waiting, n, total = np.zeros((0, 2), np.uint64), [], 0, 0
        for batch in batches:
            for t in _of_batch(batch, size, None):
                waiting.append(np.stack([t["anchor"], t["print"]], 1))
                n += len(t["n"])
                total += len(t["n"])
            if n > KEPT:
                pairs, waiting, n = _distinct(np.concatenate([pairs, *waiting])), [], 0
        pairs = _distinct(np.concatenate([pairs, *waiting]))
        anchor, count = np.unique(pairs[:, 0], return_counts=True)
        anchor, count = anchor[count > 1], count[count > 1]
        yield pa.RecordBatch.from_arrays([pa.array([None, *anchor.view(np.int64).tolist()], pa.int64()), pa.array([total, *count.tolist()], pa.int64())], ["anchor", "n"])

    return in_arrow(docs, run, "anchor long, n long")


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    keep = np.ones(len(pairs), bool)
    keep[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[keep]


_PACKED = "bucket int, copies boolean, " + ", ".join(f"{c} binary" for c in KINDS)
_ROWS = "copies boolean, anchor long, doc long, crc long, start long, n long, off int"


def _sent(docs: DataFrame, size: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """The stretches by bucket of their anchor, in packed columns. Of equal ones a map task sends the
    earliest; the others are copies for sure, and go as such by bucket of their text."""

    def blocks(t: dict[str, np.ndarray], key: np.ndarray, copies: bool) -> pa.RecordBatch:
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        at, edge = np.unique(bucket[by], return_index=True)
        columns = [pa.array([_planes(t[c].astype(kind)[by][a:b]) for a, b in zip(edge, [*edge[1:], len(by)])], pa.binary()) for c, kind in KINDS.items()]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([copies] * len(at), pa.bool_()), *columns], ["bucket", "copies", *KINDS])

    def send(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        t, head, later = _classes(_join(parts))
        first, gone = _take(t, head), _runs(_take(t, later))
        yield blocks(first, first["anchor"], False)
        if len(gone["n"]):
            yield blocks(gone, gone["doc"].view(np.uint64), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for t in _of_batch(batch, size, hot):
                parts.append(t)
                n += len(t["n"])
            if n >= KEPT:
                yield from send(parts)
                parts, n = [], 0
        if n:
            yield from send(parts)

    return in_arrow(docs, run, _PACKED)


def _settled(sent: DataFrame) -> DataFrame:
    """Of each anchor: copies to remove, and where there are different stretches, these."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        flags = table.column("copies").to_pylist()
        parts = {copies: [k for k, f in enumerate(flags) if f == copies] for copies in (True, False)}
        held = {c: table.column(c) for c in KINDS}
        whole = {copies: _join([{c: _values(held[c][k].as_py(), kind) for c, kind in KINDS.items()} for k in at]) for copies, at in parts.items() if at}
        if True in whole:
            out.append((True, whole[True]))
        if False in whole:
            t, head, later = _classes(whole[False])
            if later.any():
                out.append((True, _runs(_take(t, later))))
            t = _take(t, head)
            opens = np.flatnonzero(np.concatenate([[True], t["anchor"][1:] != t["anchor"][:-1]]))
            many = np.repeat(np.diff(np.append(opens, len(t["n"]))) > 1, np.diff(np.append(opens, len(t["n"]))))
            out.append((False, _take(t, many)))
        kinds = {"anchor": np.int64, "doc": np.int64, "crc": np.int64, "start": np.int64, "n": np.int64, "off": np.int32}
        tables = [
            pa.Table.from_arrays([pa.array(np.full(len(t["n"]), copies)), *[pa.array(t[c].view(k) if c == "anchor" else t[c].astype(k)) for c, k in kinds.items()]], ["copies", *kinds])
            for copies, t in out
        ]
        return pa.concat_tables(tables) if tables else pa.Table.from_pylist([], pa.schema([("copies", pa.bool_()), *[(c, pa.from_numpy_dtype(k)) for c, k in kinds.items()]]))

    return sent.groupBy("bucket").applyInArrow(run, _ROWS)


def mark(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, anchor: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches that may share anchors, the runs of starts whose string also stands in a stretch
    that is earlier by ``order``: (stretch, first start, number)."""
    half = (size - GRAM) // 2
    lens = np.diff(offsets)
    n = lens - size + 1
    split = np.clip(off - half, 0, n)  # starts before it are left of the middle
    piece, lo, hi, fixed = [], [], [], []
    for left in (True, False):
        some = np.flatnonzero(split > 0 if left else split < n)
        first, end = (np.zeros(len(some), np.int64), split[some]) if left else (split[some], n[some])
        begin = offsets[some] + off[some] - (half if left else 0)
        until = offsets[some] + off[some] + (GRAM if left else size - half)
        held = [data[a:b].tobytes() + (b"l" if left else b"r") for a, b in zip(begin, until)]
        piece.append(some)
        lo.append(first)
        hi.append(end)
        fixed += held
    piece, lo, hi = np.concatenate(piece), np.concatenate(lo), np.concatenate(hi)
    if not len(piece):
        return piece, lo, hi
    numbers: dict[bytes, int] = {}
    group = np.array([numbers.setdefault(f, len(numbers)) for f in fixed], np.int64)
    by = np.lexsort((order[piece], group))
    piece, lo, hi, group = piece[by], lo[by], hi[by], group[by]
    opens = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.arange(len(group)) - np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0))
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(int(rank.max()).bit_length()):
        block = group * (len(group) + 1) + (rank >> (k + 1))
        right = (rank >> k & 1).astype(bool)
        live = hi > lo
        use = np.flatnonzero(live)
        both = np.intersect1d(block[use][right[use]], block[use][~right[use]])
        use = use[np.isin(block[use], both)]
        if not len(use):
            continue
        tag = np.searchsorted(both, block[use])
        r = right[use]
        begin, length = offsets[piece[use]] + lo[use], hi[use] - lo[use] + size - 1
        index = RunIndex(data, begin[~r], length[~r], tag[~r])
        match = index.matching(data, begin[r], length[r], tag[r]) >= size
        ends = np.cumsum(length[r])
        seen = np.concatenate([[0], np.cumsum(match)])
        streamed = use[r]
        some = np.flatnonzero(seen[ends] > seen[ends - length[r]])
        for j in some.tolist():
            s = streamed[j]
            own = np.flatnonzero(match[ends[j] - length[r][j] : ends[j]]) + lo[s]
            marks.append((np.full(len(own), piece[s]), own))
            stay = np.setdiff1d(np.arange(lo[s], hi[s]), own, assume_unique=True)
            lo[s], hi[s] = (stay[0], stay[-1] + 1) if len(stay) else (0, 0)
    if not marks:
        return piece[:0], lo[:0], hi[:0]
    who, at = (np.concatenate(c) for c in zip(*marks, strict=True))
    by = np.lexsort((at, who))
    who, at = who[by], at[by]
    fresh = np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1])])
    who, at = who[fresh], at[fresh]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)]))
    return who[first], at[first], np.diff(np.append(first, len(at)))


_CUT = "bucket int, anchor long, doc long, crc long, start long, off int, piece binary"
_MARKS = "doc long, crc long, start long, n long"


def _cut(docs: DataFrame, wanted: DataFrame, size: int, buckets: int) -> DataFrame:
    """The bytes of the stretches that share an anchor with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            spans = batch.column("spans")
            rows = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
            got = {c: spans.flatten().field(c).to_numpy() for c in ("start", "n", "off", "anchor")}
            begin = offsets[rows] + got["start"]
            end = begin + got["n"] + size - 1
            for a in range(0, len(rows), 1 << 12):
                k = slice(a, a + (1 << 12))
                keep = batch.take(pa.array(rows[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mix(got["anchor"][k].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.array(got["anchor"][k]), keep.column("doc"), keep.column("crc"), pa.array(got["start"][k]), pa.array(got["off"][k]), pa.array([data[x:y].tobytes() for x, y in zip(begin[k], end[k])], pa.binary())],
                    ["bucket", "anchor", "doc", "crc", "start", "off", "piece"],
                )

    spans = wanted.groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "n", "off", "anchor")).alias("spans"))
    found = docs.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))).join(spans.hint("shuffle_hash"), ["doc", "crc"])
    return in_arrow(found.select("doc", "crc", "text", "spans"), run, _CUT)


def _matched(pieces: DataFrame, size: int) -> DataFrame:
    """Starts that match an earlier stretch of their anchor, as (doc, crc, start, n)."""

    def run(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in ("anchor", "doc", "crc", "start", "off")}
        by = np.lexsort((t["start"], t["crc"], t["doc"]))
        again = (np.diff(t["doc"][by]) == 0) & (np.diff(t["crc"][by]) == 0) & (np.diff(t["start"][by]) == 0)
        by = by[np.append(True, ~again)]  # rows that are one document give the same stretches
        data, offsets = utf8(table.column("piece").take(pa.array(by)))
        who, first, n = mark(data, offsets, np.arange(len(by)), t["anchor"][by], t["off"][by].astype(np.int64), size)
        at = by[who]
        return pa.Table.from_arrays([pa.array(t["doc"][at]), pa.array(t["crc"][at]), pa.array(t["start"][at] + first), pa.array(n)], ["doc", "crc", "start", "n"])

    return pieces.groupBy("bucket").applyInArrow(run, _MARKS)


def _dealt(rows: int, most: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def repeated(docs: DataFrame, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """(doc, crc, start, n): runs of starts whose ``size`` bytes also start earlier in the corpus. ``docs``
    has columns doc (a long, never null) and text (never null). The table is written down."""
    spark = docs.sparkSession
    counted = materialize(_counted(docs, size), "repeats-counted")
    rows = counted.filter("anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    often = counted.filter("anchor IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot)
    frequent = np.sort(np.array([r["anchor"] for r in often.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).collect()], np.int64).view(np.uint64))
    release(counted)
    settled = materialize(_settled(_sent(docs, size, frequent, _dealt(rows, BUCKET, spark))), "repeats-settled")
    wanted = settled.filter(~F.col("copies"))
    buckets = _dealt(wanted.count(), INDEX_BYTES // (size + GRAM), spark)
    marks = _matched(_cut(docs, wanted.select("doc", "crc", "start", "n", "off", "anchor"), size, buckets), size)
    found = materialize(marks.union(settled.filter("copies").select("doc", "crc", "start", "n")), "repeats-found")
    release(settled)
    return found


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, hot: int = HOT) -> DataFrame:
    """(id, kept_text binary, n_bytes, n_removed, n_spans, kept_sha256) of every row: its bytes without
    those that a string of ``size`` bytes covers which also starts earlier."""
    if size < 2 * GRAM:
        raise ValueError(f"size must be {2 * GRAM} or more")
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text).alias("text"))
    marks = repeated(plain.select("doc", "text"), size, hot).groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            spans = batch.column("spans")
            ends = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())])
            starts, counts = (spans.flatten().field(c).to_numpy() for c in ("start", "n"))
            kept, rows = [], []
            for k in range(len(batch)):
                own = data[offsets[k] : offsets[k + 1]]
                at, n = starts[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
                if len(at):
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + n + size - 1, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    spans_here = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                else:
                    spans_here = 0
                raw = own.tobytes()
                n_bytes = int(offsets[k + 1] - offsets[k])
                kept.append(raw)
                rows.append((n_bytes, n_bytes - len(raw), spans_here, hashlib.sha256(raw).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                ["id", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema[id].dataType.simpleString()
    found = plain.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))).join(marks.hint("shuffle_hash"), ["doc", "crc"], "left").select("id", "text", "spans")
    return in_arrow(found, run, f"id {kind}, kept_text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id)


def oracle(size: int = SIZE) -> str:
    """The result of op11 in DuckDB, from every string of ``size`` bytes; ids must be unique."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * (64 + size - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {size - 1}, 64)) AS p FROM d)),
w AS (SELECT doc_id, p + i AS i, md5_number(substr(h, 2 * i + 1, {2 * size})) AS s FROM (SELECT doc_id, p, h, unnest(range(least(64, len(h) // 2 - {size - 1}))) AS i FROM c)),
f AS (SELECT s, min((doc_id, i)) AS first FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE (doc_id, i) <> first),
g AS (SELECT doc_id, i, sum((before IS NULL OR i > before + {size})::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {size} AS b FROM g GROUP BY ALL),
e AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY 1),
k AS (SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(len(a), 0) AS n_spans,
             CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1, 2 * (CASE WHEN j = len(a) THEN len(h) // 2 ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))), '') END AS kept
      FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, (n_bytes - len(kept) // 2)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
