"""The trie of conversation prefixes, by an external mergesort that carries common prefixes along.

A conversation is the sequence of its turns' digests. Map tasks sort bounded runs of conversations and
note for each how many turns it shares with the one before (its LCP); the runs are cut at
splitters and dealt by range, front-coded: only turns that are not shared travel. In each range a loser tree
merges the runs. It compares LCPs with the last conversation that came out and looks at turns
only where these tie, from the shared ones on, so no shared turn is compared again. The
merged stream keeps a stack of open nodes, the path of the last conversation; what the next does not share
is finished and goes out.

Ranges are cut by (turns, id), so that conversations that are alike, or share their first turns, may lie in
many. Nodes of a path that goes on in the range before or after are partial: each range adds its part, a node
being new only in the first range that has it. These few rows (a path or two for each range) are
summed up by node.

Defined results: rows without conv_id belong to no conversation; turns of equal number stand in the order of
their digests; repeated rows are turns of their own; null role and text are empty; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, small_batches, small_side

#: Bytes of a turn's digest (the first half of a SHA-256), and as hexadecimal digits.
DIGEST = 16
#: Bytes of digests in one run, and in one range.
RUN_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Conversations that the splitters of a range are picked from.
SAMPLE = 8
#: Bytes of ids in one row of a node that lies in many ranges.
ENDS_BYTES = 1 << 20


def sequences(table: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns array<struct<digest hex string, size>>) of each conversation in the order of its turns."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    one = F.struct(
        F.col(turn).isNotNull().alias("numbered"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * DIGEST).alias("digest"),
        F.length(said).cast("long").alias("size"),
    )
    use = table.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv"), one.alias("t"))
    return use.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv", F.expr("transform(t, x -> named_struct('digest', x.digest, 'size', x.size))").alias("turns"))


def shared_heads(convs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first of its group
    of ids; h is the CRC-32 of its id modulo ``most`` + 1."""
    named = convs.withColumn("head_id", F.col("conv") - F.col("conv") % group)
    heads = named.filter(F.col("conv") == F.col("head_id")).select("head_id", F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = named.join(heads, "head_id", "left").withColumn("h", h)
    return both.select("conv", F.expr("concat(coalesce(slice(head, 1, h), cast(array() AS array<struct<digest:string,size:bigint>>)), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


def _keys(convs: DataFrame) -> DataFrame:
    """(conv, key binary of all digests, sizes)."""
    return convs.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.expr("transform(turns, t -> t.size)").alias("sizes"))


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two keys share, if ``start`` of them are known to."""
    n, at = min(len(a), len(b)), start * DIGEST
    while at < n and a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


class Run:
    """A sorted run: keys, ids and sizes; ``shared`` with the entry before it (0 for the first)."""

    def __init__(self, keys: list[bytes], ids: list[int], sizes: list[list[int]], shared: list[int]):
        self.keys, self.ids, self.sizes, self.shared = keys, ids, sizes, shared


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, list[int], int]]:
    """All entries of the runs in order of (key, id), each with what it shares with the one before.

    A loser tree: a node keeps the run that lost there. Every loser on the path of the last
    winner knows what it shares with that winner, so two heads with different LCPs are told apart
    by these alone; else turns are compared from the LCP on.
    """
    k = len(runs)
    at = [0] * k
    head = [r.shared[0] if r.keys else 0 for r in runs]  # what a run's head shares with the last winner
    over = [not r.keys for r in runs]

    def wins(a: int, b: int) -> bool:
        """Whether the head of run a comes before that of b; the loser then knows what it shares with the winner."""
        if over[a] or over[b]:
            return over[b]
        if head[a] != head[b]:
            return head[a] > head[b]
        x, y = runs[a].keys[at[a]], runs[b].keys[at[b]]
        n = lcp(x, y, head[a])
        if n * DIGEST < max(len(x), len(y)):
            first = x[n * DIGEST : (n + 1) * DIGEST] < y[n * DIGEST : (n + 1) * DIGEST]
        else:
            first = runs[a].ids[at[a]] <= runs[b].ids[at[b]]
        head[b if first else a] = n
        return first

    loser = [-1] * max(1, k)
    winner = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        first = wins(a, b)
        winner[node], loser[node] = (a, b) if first else (b, a)
    best = winner[1] if k > 1 else 0
    while k and not over[best]:
        run, i = runs[best], at[best]
        yield run.keys[i], run.ids[i], run.sizes[i], head[best]
        at[best] = i + 1
        if i + 1 < len(run.keys):
            head[best] = run.shared[i + 1]
        else:
            over[best] = True
        node = (best + k) >> 1
        while node:
            if wins(loser[node], best):
                loser[node], best = best, loser[node]
            node >>= 1


class Node:
    """An open node: what of it the range's stream has shown so far."""

    __slots__ = ("children", "conv", "convs", "ends", "inner", "leaves", "new", "saved", "size", "waiting")

    def __init__(self, size: int, new: bool):
        self.size, self.new, self.inner = size, new, False
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # finished children; they go out with the parent's id

    def hold(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs


#: What a range tells: finished nodes; finished nodes whose parent lies in several ranges; parts of such.
DONE, CHILD, PART = 0, 1, 2
_COLUMNS = ["kind", "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends", "node", "above", "span", "nth"]
_FOUND = "kind int, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string, node string, above string, span int, nth int"
EMPTY = hashlib.sha256().hexdigest()


def _name(key: bytes, depth: int) -> str:
    """What ranges call a node that several of them hold."""
    return hashlib.sha256(key[: depth * DIGEST]).hexdigest()


def _joined(ids: list[int]) -> Iterator[str]:
    """The ids, comma-joined, in strings of about ENDS_BYTES."""
    step = ENDS_BYTES // 20
    for lo in range(0, len(ids), step):
        yield ",".join(map(str, ids[lo : lo + step]))


def nodes(stream: Iterator[tuple[bytes, int, list[int], int]], span: int = 0, before: int = -1, after: int = -1) -> Iterator[tuple]:
    """Rows of the nodes of one range's merged stream. ``before`` and ``after``: turns that its first conversation
    shares with the last one of the ranges before, and its last with the first one after; -1 if there is none."""
    path: list[Node] = []
    key = b""

    def close(final: bool) -> Iterator[tuple]:
        node, depth = path.pop(), len(path)
        goes_on = final and depth <= after
        if not node.inner and not goes_on:  # where the next range holds it too, that one can tell
            node.leaves += 1
        node.saved += (node.convs - node.new) * node.size
        partial = goes_on or not node.new
        name = _name(key, depth) if partial else None
        kind, parent = (CHILD, None) if partial else (DONE, node.conv)
        for row in node.waiting:
            yield (kind, *row[:2], parent, *row[3:], None, name, span, 0)
        own = (node.conv, depth, None, node.convs, node.children, node.leaves, node.saved)
        if partial:
            above = _name(key, depth - 1) if depth else None
            yield (PART, *own, None, name, above, span, 0)
            for k, ends in enumerate(_joined(node.ends)):
                yield (PART, None, depth, None, 0, 0, 0, 0, ends, name, above, span, k + 1)
        else:
            own = (*own, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY)
            if path:
                path[-1].waiting.append(own)
            else:
                yield (DONE, *own, None, None, span, 0)
        if path:
            up = path[-1]
            up.hold(node.conv, node.convs)
            up.inner = True
            up.children += node.new
            up.leaves += node.leaves
            up.saved += node.saved

    first = True
    for now, conv, sizes, shared in stream:
        if first:
            path.append(Node(0, before < 0))
            shared = 0
        while len(path) - 1 > shared:
            yield from close(False)
        for depth in range(shared + 1, len(sizes) + 1):
            path.append(Node(sizes[depth - 1], not first or depth > before))
        key, first = now, False
        path[-1].ends.append(conv)
        path[-1].hold(conv, 1)
    while path:
        yield from close(True)


_SEGMENTS = "span int, first binary, first_id long, last binary, last_id long, ids array<long>, shared array<int>, depth array<int>, sizes array<long>, tails binary"


def _segments(keys: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    """Sorted runs with their LCPs, cut by range and front-coded."""

    def sort(entries: list[tuple[bytes, int, list[int]]]) -> pa.RecordBatch:
        entries.sort(key=lambda e: e[:2])
        rows, lo = [], 0
        while lo < len(entries):
            span = bisect_right(splitters, entries[lo][:2])
            hi = bisect_left(entries, splitters[span], lo, key=lambda e: e[:2]) if span < len(splitters) else len(entries)
            part, shared, tails, sizes = entries[lo:hi], [], [], []
            lo = hi
            for k, (key, _, size) in enumerate(part):
                n = lcp(part[k - 1][0], key) if k else 0
                shared.append(n)
                tails.append(key[n * DIGEST :])
                sizes += size[n:]
            rows.append((span, part[0][0], part[0][1], part[-1][0], part[-1][1], [e[1] for e in part], shared, [len(e[2]) for e in part], sizes, b"".join(tails)))
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["span", "first", "first_id", "last", "last_id", "ids", "shared", "depth", "sizes", "tails"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, size = [], 0
        for batch in batches:
            for conv, key, sizes in zip(*[batch.column(c).to_pylist() for c in ("conv", "key", "sizes")], strict=True):
                entries.append((key, conv, sizes))
                size += len(key) + DIGEST
            if size > RUN_BYTES:
                yield sort(entries)
                entries, size = [], 0
        if entries:
            yield sort(entries)

    return in_arrow(keys, run, _SEGMENTS)


def _run(row: dict) -> Run:
    """A segment as it was before it was front-coded."""
    keys, sizes, key, size, at = [], [], b"", [], 0
    for n, depth in zip(row["shared"], row["depth"], strict=True):
        more = depth - n
        key = key[: n * DIGEST] + row["tails"][at * DIGEST : (at + more) * DIGEST]
        size = size[:n] + row["sizes"][at : at + more]
        at += more
        keys.append(key)
        sizes.append(size)
    return Run(keys, row["ids"], sizes, row["shared"])


def _ends(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that lie in several ranges. A hash is a chain over one string: its
    rows of up to ENDS_BYTES pass through one task, in order, none of them kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != name:
                    if name is not None:
                        rows.append((name, state.hexdigest()))
                    name, state = node, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["node", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ordered = parts.filter("ends IS NOT NULL").repartition("node").sortWithinPartitions("node", "span", "nth").select("node", "ends")
    return in_arrow(ordered, run, "node string, ends_sha256 string")


def trie(convs: DataFrame, ranges: int = 0) -> DataFrame:
    """The nodes of all prefixes of (conv, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``ranges``: how many at least (default: the shuffle's partitions)."""
    spark = convs.sparkSession
    small_batches(spark)
    keys = materialize(_keys(convs), "trie-keys")
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    n = size["n"]
    ranges = max(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // RANGE_BYTES))
    sample = sorted((bytes(r["key"]), r["conv"]) for r in keys.sample(min(1.0, SAMPLE * ranges / max(1, n)), seed=17).select("key", "conv").collect())
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    segments = materialize(_segments(keys, splitters), "trie-runs")
    edges = segments.groupBy("span").agg(F.min(F.struct("first", "first_id")).alias("first"), F.max(F.struct("last", "last_id")).alias("last")).orderBy("span").collect()
    spans = [r["span"] for r in edges]
    met = [lcp(bytes(a["last"]["last"]), bytes(b["first"]["first"])) for a, b in zip(edges, edges[1:])]
    before, after = dict(zip(spans, [-1, *met], strict=False)), dict(zip(spans, [*met, -1], strict=False))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        span = rows[0]["span"]
        found = list(nodes(merge([_run(r) for r in rows]), span, before[span], after[span]))
        kinds = [pa.int32(), *[pa.int64()] * 7, *[pa.string()] * 3, *[pa.int32()] * 2]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], _COLUMNS)

    found = materialize(segments.groupBy("span").applyInArrow(run, _FOUND), "trie-nodes")
    parts = found.filter(F.col("kind") == PART)
    sums = parts.groupBy("node").agg(F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("above").alias("above"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    shared = materialize(sums.join(_ends(parts), "node", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("ends_sha256"), "trie-shared")
    parents = small_side(shared.select(F.col("node").alias("above"), F.col("conv").alias("parent")))
    columns: list[Column | str] = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    whole = found.filter(F.col("kind") == DONE).select(columns)
    below = found.filter(F.col("kind") == CHILD).drop("parent").join(parents, "above").select(columns)
    across = shared.join(parents, "above", "left").select(columns)
    release(keys, segments)
    return whole.union(below).union(across).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle(group: int = 100, most: int = 5) -> str:
    """The result of op12 in DuckDB; the checksum of an id is computed from its rule."""
    polynomial, ones = 0xEDB88320, 0xFFFFFFFF
    step = "xor(c, x)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, {polynomial}::BIGINT) ELSE v >> 1 END)[1]"
    return f"""
WITH t AS (SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, said, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS k FROM t),
b AS (SELECT conv_id, list_prepend({ones}::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS b FROM (SELECT DISTINCT conv_id FROM o)),
h AS (SELECT conv_id, xor(list_reduce(b, lambda c, x: {step}), {ones}::BIGINT) % {most + 1} AS h FROM b),
r AS (SELECT h.conv_id, 0 AS own, k, said, size FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % {group} AND k <= h
      UNION ALL SELECT conv_id, 1, k, said, size FROM h JOIN o USING (conv_id) WHERE k > h),
c AS (SELECT h.conv_id, coalesce(list(said ORDER BY own, k) FILTER (k IS NOT NULL), []) AS p, coalesce(list(size ORDER BY own, k) FILTER (k IS NOT NULL), []) AS z FROM h LEFT JOIN r USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, d, len(p) AS n, md5(to_json(p[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(to_json(p[1:d - 1])::VARCHAR) END AS above, CASE WHEN d > 0 THEN z[d] ELSE 0 END AS size,
             list_transform(range(d + 1), lambda e: md5(to_json(p[1:e])::VARCHAR)) AS line FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM c)),
v AS (SELECT node, any_value(above) AS above, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(line) AS line,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY node),
k AS (SELECT above AS node, count(*) AS n_children FROM v WHERE above IS NOT NULL GROUP BY 1),
u AS (SELECT node, unnest(line) AS up, (n_convs - 1) * size AS saved, (node NOT IN (SELECT node FROM k))::INTEGER AS leaf FROM v),
s AS (SELECT up AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN v p ON p.node = v.above
"""
