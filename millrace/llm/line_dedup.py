"""Line dedup by a deletion-neighbourhood join.

A line is compared by its normal form: A-Z in lower case, white space as one space,
ends trimmed. It goes if an earlier line (by document id, then place) lies within one
edit of it: one code point put in, taken out or changed. Equal lines meet by their
hash. For the rest every line emits its variants, itself and each result of deleting
one code point, as hashed keys with the place of the deletion, and equal keys are
joined. Lines that agree on key and place differ by a change there; a line that equals
a variant of another differs by what that one lacks. So each line needs to meet only
the earliest of either kind, never all lines of a key, and the edit distance of such a
pair is verified. A key holds one row for each distinct line that one code point put
into the same string can make: as many as it has places and letters to put there, not
as many as the table has rows.

Most lines have no such neighbour. Of two lines within an edit, the shorter of length
m, either the first m div 2 code points agree or the last m - m div 2 do, so lines that
share neither half with another one of fitting length emit no variants.

Every line with a word takes part. Those under ``MIN_WORDS`` words and ``POINTS`` code
points go only if an earlier line equals them, since one edit of few code points is
another word or number; lines of nothing but white space and ASCII punctuation stay.

Defined results: null and empty texts have no lines to drop; null ids come before all
others; rows equal in id and text are one row to the dedup and each get its result; an
empty table gives an empty result; other columns, whatever their names, pass through
``clean`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, slices, small_batches, small_side, text_of, unused, utf8
from millrace.llm.hashing import mix

MIN_WORDS = 5
#: A line of so many code points is compared with one edit whatever its words: scripts without spaces have few.
POINTS = 25
#: Variants that a task gathers before it hands them on.
GATHER = 50_000
_LETTER = np.array([chr(b).isalnum() for b in range(128)])
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse."""
    global _up, _down
    if len(_up) < n:
        for name, base in (("_up", _ODD), ("_down", _INVERSE)):
            grown = np.full(max(n, 2 * len(_up), 1024), base, np.uint64)
            grown[0] = 1
            globals()[name] = np.multiply.accumulate(grown)
    return _up, _down


class Lines:
    """The lines of some texts in normal form: code points, bounds, where they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        text_at = heads[offsets]
        feed = cp == 10
        begin = np.zeros(len(cp) + 1, bool)
        begin[text_at] = True
        begin[1:] |= feed
        first = np.flatnonzero(begin[:-1]) if len(cp) else np.zeros(0, np.int64)
        white = (cp == 32) | ((cp >= 9) & (cp <= 13))
        before = np.ones(len(cp), bool)
        before[1:] = white[:-1]
        before[first] = True
        word = ~white & before
        gap = np.zeros(len(cp), bool)  # the white space that stands for all between two words
        at = np.flatnonzero(word)
        line = np.cumsum(begin[:-1]) - 1
        later = at[1:][line[at[1:]] == line[at[:-1]]] if len(at) else at
        gap[later - 1] = True
        keep = ~white | gap
        out = cp[keep].astype(np.uint64)
        out[gap[keep]] = 32
        out[(out >= 65) & (out <= 90)] += np.uint64(32)
        n = np.bincount(line[keep], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        end = np.cumsum(n)
        words = np.bincount(line[at], minlength=len(first)) if len(first) else n
        near = (words >= MIN_WORDS) | (n >= POINTS)
        ink = np.flatnonzero(~white & ((cp >= 128) | _LETTER[np.minimum(cp, 127)]))
        pick = np.flatnonzero(np.bincount(line[ink], minlength=len(first)) > 0) if len(first) else np.flatnonzero(near)
        self.near = near[pick]  # whether one edit counts
        row = np.searchsorted(text_at, first, "right") - 1
        # an empty text has the bounds of the next one: the last of those that begin here owns the line
        nth = np.arange(len(first)) - np.searchsorted(first, text_at[row])
        self.start, self.size, self.row, self.nth = (end - n)[pick], n[pick], row[pick], nth[pick]
        self.point = out
        up, down = _powers(int(n.max()) + 2 if len(n) else 2)
        self.value = mix(out + np.uint64(1))
        place = np.arange(len(out)) - np.repeat(end - n, n)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value * up[place])])
        self.hash = self._of(self.sum[self.start + self.size] - self.sum[self.start], self.size, 0)

    @staticmethod
    def _of(raw: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
        return mix(raw + (size.astype(np.uint64) * np.uint64(8) + np.uint64(salt)) * np.uint64(_INVERSE))

    def halves(self) -> np.ndarray:
        """(lines by 4) keys: the head and the tail, for the length as the shorter and as the longer of a pair."""
        _, down = _powers(2)
        out = []
        for m in (self.size, self.size - 1):
            h = m // 2
            tail = m - h
            out.append(self._of(self.sum[self.start + h] - self.sum[self.start], m, 1))
            from_ = self.start + self.size - tail
            out.append(self._of((self.sum[self.start + self.size] - self.sum[from_]) * down[self.size - tail], m, 2))
        return np.stack(out, axis=1)

    def variants(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, place) of line k: without each of its code points, and itself at place -1."""
        up, down = _powers(int(self.size[k]) + 2)
        s, n = int(self.start[k]), int(self.size[k])
        cut = np.arange(n)
        head = self.sum[s + cut] - self.sum[s]
        rest = (self.sum[s + n] - self.sum[s + cut + 1]) * down[1]
        less = self._of(head + rest, np.full(n, n - 1), 0)
        return np.append(less, self.hash[k]), np.append(cut, -1).astype(np.int32)


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance of two strings is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def normal(line: str) -> str:
    """The normal form of one line."""
    out = "".join(c if c not in "\t\n\v\f\r " else " " for c in line)
    return " ".join(w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in out).split(" ") if w)


def _signed(u: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.ascontiguousarray(u).view(np.int64), mask=null)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, fp, nth, h, k1 to k4) of every line that takes part; no keys where only equal lines count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            for lo, _, d, o in slices(data, offsets):
                x = Lines(d, o)
                if len(x.hash):
                    row = pa.array(x.row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(row), batch.column("fp").take(row), pa.array(x.nth.astype(np.int32)), _signed(x.hash), *[_signed(k, ~x.near) for k in x.halves().T]],
                        ["id", "fp", "nth", "h", "k1", "k2", "k3", "k4"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.transform(in_arrow, run, f"id {kind}, fp long, nth int, h long, k1 long, k2 long, k3 long, k4 long")


def _variants(texts: DataFrame) -> DataFrame:
    """(id, fp, nth, h, key, place, line) of the wanted lines of these texts: a row for each variant, and one with the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            want = batch.column("nths").to_pylist()
            for lo, hi, d, o in slices(data, offsets):
                x = Lines(d, o)
                at = np.searchsorted(x.row, np.arange(hi - lo + 1))
                held, n = [], 0
                for r in range(hi - lo):
                    own = slice(at[r], at[r + 1])
                    for k in (np.flatnonzero(np.isin(x.nth[own], want[lo + r])) + at[r]).tolist():
                        held.append((r + lo, int(x.nth[k]), x.hash[k], *x.variants(k), x.point[x.start[k] : x.start[k] + x.size[k]].astype(np.uint32).tobytes().decode("utf-32-le")))
                        n += len(held[-1][3]) + 1
                        if n > GATHER:
                            yield _variant_rows(batch, held)
                            held, n = [], 0
                if held:
                    yield _variant_rows(batch, held)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "fp", "t", "nths").transform(in_arrow, run, f"id {kind}, fp long, nth int, h long, key long, place int, line string")


def _variant_rows(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
    """Rows of some lines (row, nth, hash, keys, places, line); each line's text comes first, without a key."""
    row, nth, h, keys, places, lines = zip(*held, strict=True)
    many = np.array([len(k) + 1 for k in keys])
    first = np.cumsum(many) - many
    key, place, text = np.zeros(many.sum(), np.uint64), np.zeros(many.sum(), np.int32), np.full(many.sum(), None, object)
    is_line = np.zeros(many.sum(), bool)
    is_line[first] = True
    key[~is_line], place[~is_line], text[first] = np.concatenate(keys), np.concatenate(places), lines
    take = pa.array(np.repeat(row, many))
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(take), batch.column("fp").take(take), pa.array(np.repeat(nth, many).astype(np.int32)), _signed(np.repeat(np.array(h, np.uint64), many)), _signed(key, is_line), pa.array(place, mask=is_line), pa.array(text, pa.string())],
        ["id", "fp", "nth", "h", "key", "place", "line"],
    )


def _verify(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (h, e) whose lines are within one edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a, b) for a, b in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("e"), pa.array(good, pa.bool_())], ["h", "e", "good"])

    a = lines.select("h", F.col("line").alias("la"))
    b = lines.select(F.col("h").alias("e"), F.col("line").alias("lb"))
    return pairs.join(a, "h").join(b, "e").select("h", "e", "la", "lb").transform(in_arrow, run, "h long, e long, good boolean")


def _near(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, fp, nths): the rows whose lines emit variants, each distinct line where it stands first."""
    halves = found.select("h", F.explode(F.array("k1", "k2", "k3", "k4")).alias("key")).filter("key IS NOT NULL")
    met = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    met = materialize(met, "lines-met")
    near = materialize(halves.join(small_side(met), "key").select("h").distinct(), "lines-near")
    release(met)
    asked = firsts.join(small_side(near), "h").groupBy("at.id", "at.fp").agg(F.collect_list("at.nth").alias("nths"))
    asked = materialize(asked.select(F.col("id").alias("i"), F.col("fp").alias("f"), "nths"), "lines-asked")
    release(near)
    return asked


def _neighbours(variants: DataFrame) -> DataFrame:
    """(h, e): each line with the earliest ones before it that a change, a code point less or one more makes of it."""
    at = F.struct("id", "fp", "nth", "h")
    alone = F.col("place") < 0
    rows = variants.filter("key IS NOT NULL").withColumn("at", at).select("key", "place", "at")
    whole, spot = Window.partitionBy("key"), Window.partitionBy("key", "place")
    rows = rows.withColumn("own", F.min(F.when(alone, F.col("at"))).over(whole)).withColumn("cut", F.min(F.when(~alone, F.col("at"))).over(whole))
    rows = rows.withColumn("same", F.min("at").over(spot))
    before = F.when(alone, F.col("cut")).otherwise(F.least("same", "own"))
    return rows.withColumn("e", before).filter("e < at").select("at.h", F.col("e.h").alias("e")).distinct()


def dropped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, nth, edited): the lines that go, by row (id and hash of its text) and place;
    edited is whether only a line within one edit, not an equal one, comes before."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id).alias("id"), F.xxhash64(text_of(text)).alias("fp"), text_of(text).alias("t"))
    found = materialize(_lines(source), "lines")
    place = F.struct("id", "fp", "nth")
    firsts = materialize(found.groupBy("h").agg(F.min(place).alias("at"), F.count("*").alias("c")), "line-firsts")
    asked = _near(found, firsts)
    texts = source.join(small_side(asked, 200_000), (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("i")))
    both = materialize(_variants(texts), "line-variants")
    release(asked)
    # rows equal in id and text emit the same lines
    lines = both.filter("line IS NOT NULL").select("h", "line").dropDuplicates(["h"])
    pairs = materialize(_neighbours(both), "line-pairs")
    gone = materialize(_verify(pairs, lines).filter("good").select("h").distinct(), "lines-gone")
    release(both, pairs)

    wanted = firsts.join(small_side(gone.withColumn("edited", F.lit(True)), 1_000_000), "h", "left").filter("c > 1 OR edited").select("h", "at", "edited")
    wanted = materialize(wanted, "lines-wanted")
    release(firsts, gone)
    marked = found.select("id", "fp", "nth", "h").join(small_side(wanted), "h")
    later = ~place.eqNullSafe(F.col("at"))
    drops = materialize(marked.filter(later | F.col("edited")).select("id", "fp", "nth", (~later).alias("edited")).distinct(), "lines-dropped")
    release(found, wanted)
    return drops


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, n_edited, dropped array<int>) of every row."""
    gone = dropped(docs, id, text)
    by_row = gone.groupBy(F.col("id").alias("i"), F.col("fp").alias("f")).agg(F.array_sort(F.collect_list("nth")).alias("dropped"), F.count_if("edited").alias("n_edited"))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text_of(text)).alias("fp"), F.size(F.split(text_of(text), "\n", -1)).cast("long").alias("n_lines"))
    joined = rows.join(by_row, (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return joined.select(
        F.col("id").alias(id), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("n_edited", F.lit(0)).cast("long").alias("n_edited"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that go, other columns as they are. A document goes
    too if it loses lines and no word is left; near copies are for the Jaccard stage. Lines
    keep their order."""
    i, f, gone, new = unused(docs, "i", "f", "gone", "new")
    by_row = dropped(docs, id, text).groupBy(F.col("id").alias(i), F.col("fp").alias(f)).agg(F.collect_list("nth").alias(gone))
    by_row = small_side(materialize(by_row, "lines-by-row"), 200_000)
    joined = docs.join(by_row, (F.xxhash64(text_of(text)) == F.col(f)) & F.col(id).eqNullSafe(F.col(i)), "left")
    left = F.expr(f"array_join(filter(split(`{text}`, '\\n', -1), (x, k) -> NOT array_contains(`{gone}`, k)), '\\n')")
    whole = F.col(new).rlike("[^\\x00- !-/:-@\\[-`{-\\x7f]")  # a word: neither white space nor ASCII punctuation
    kept = joined.withColumn(new, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)).filter(F.col(gone).isNull() | whole)
    return kept.select(*[F.col(new).alias(c) if c == text else F.col(c) for c in docs.columns])


def oracle() -> str:
    """The digest of op7 in DuckDB: lines of the same half are compared code point by code point."""
    return rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS nth FROM documents),
norm AS (SELECT doc_id, nth, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM lines),
part AS (SELECT * FROM norm WHERE regexp_matches(line, '[0-9a-z]|[^\x00-\x7F]')),
firsts AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'n': nth}}) AS pos FROM part GROUP BY line),
near AS (SELECT * FROM firsts WHERE n >= {POINTS} OR len(string_split(line, ' ')) >= {MIN_WORDS}),
keyed AS (SELECT line, n, pos, m, 'h' || left(line, m // 2) AS k FROM near, LATERAL (SELECT unnest([n, n - 1]) AS m)
          UNION ALL SELECT line, n, pos, m, 't' || right(line, m - m // 2) AS k FROM near, LATERAL (SELECT unnest([n, n - 1]) AS m)),
pairs AS (SELECT DISTINCT x.line AS line, e.line AS other FROM keyed x JOIN keyed e ON x.m = e.m AND x.k = e.k AND e.pos < x.pos AND abs(x.n - e.n) <= 1),
gone AS (SELECT DISTINCT line FROM (SELECT line, other, CASE WHEN length(line) <= length(other) THEN line ELSE other END AS a, CASE WHEN length(line) <= length(other) THEN other ELSE line END AS b FROM pairs)
         WHERE CASE WHEN length(a) = length(b) THEN len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) <= 1
               ELSE len(list_filter(range(1, length(b) + 1), lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0 END),
drops AS (SELECT p.doc_id, p.nth, f.pos = {{'d': p.doc_id, 'n': p.nth}} AS edited FROM part p JOIN firsts f USING (line) LEFT JOIN gone g USING (line)
          WHERE g.line IS NOT NULL OR f.pos <> {{'d': p.doc_id, 'n': p.nth}})
SELECT d.doc_id, any_value(len(string_split(coalesce(d.text, ''), chr(10))))::BIGINT AS n_lines, count(r.nth)::BIGINT AS n_dropped,
       count(*) FILTER (r.edited)::BIGINT AS n_edited, coalesce(string_agg(r.nth::VARCHAR, ',' ORDER BY r.nth), '') AS dropped
FROM documents d LEFT JOIN drops r USING (doc_id) GROUP BY d.doc_id
"""
