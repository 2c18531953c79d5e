"""N-gram Jaccard self-join by filtering under several global orders of the shingles.

Two sets whose Jaccard similarity reaches t must share a shingle among the first
n - ceil(t n) + 1 of each, under any order that is the same for all sets. Four orders
are used and their filters intersected before a pair is verified:

1. by hash, with a prefix longer by n div 8: two sets that link meet in as many of its
   shingles, so a set with fewer that any other set has leaves at once;
2. by how many of the remaining sets hold a shingle, rare ones first: what a single
   set holds cannot match, so it costs no row, and a passage that very many documents
   share stands last and makes no pairs. The pairs that meet here are then held to
3. what a single set holds first, the rest by a second hash, and
4. the same by a third hash. A pair that misses under either goes unverified: the two
   prefixes are joined and compared first, and only what is left joins the whole sets.

A passage may stand in a third of all texts. Shingles that are frequent in a part of the
texts (``SAMPLED``, by their hash) are dealt by class too, so none of them is one task's
lot. This moves rows only: such a shingle is known to have several classes, and any number
that is the same for all sets will do for its place in the order.

Equal sets are one class from the start. Links serve the components: a first round
verifies each class against the central class it shares most prefix shingles with, some
more against central classes of other components, and the last takes every remaining
pair of different components that shares a prefix shingle. So no link between different
components is missed, and a group of thousands of near copies makes no square of pairs.

Defined results: null and empty texts and texts without words have the empty set, and
link with nothing; fewer words than the shingle size make one shingle; a row whose id
is null keeps its counts and links with nothing; repeated rows and ids stay rows of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, materialize, release, slices, small_batches, small_side, text_of, unused, utf8
from millrace.llm.components import components
from millrace.llm.hashing import mix, windows, words

WORDS, PERCENT = 5, 75
#: Rounds against central classes before all remaining pairs are taken; any number gives the same result.
ROUNDS = 1
#: What sets the hashes of the two last orders apart.
ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
#: Counts of a shingle are exact up to here; all higher ones are one class of the order.
MOST_COUNTED = 65_536
#: One text of so many tells which shingles are frequent; how many classes among those make one so; into how
#: many parts its rows go; and how many such shingles there are at most, the others being rarer. None changes a result.
SAMPLED, FREQUENT, PARTS, MOST_FREQUENT = 64, 16, 64, 100_000


def prefix(n: np.ndarray | int, percent: int = PERCENT):
    """Length of the prefix in which two sets that link must meet."""
    return n + 1 + (-percent * n) // 100


def must_meet(n: np.ndarray | int):
    """In how many shingles two sets that link meet, if the prefix is as much longer, less one."""
    return np.maximum(1, n // 8)


def shingles(h: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of one text by its word hashes, in the order of their hashes."""
    if len(h) >= size:
        return np.unique(windows(h, size))
    return mix(windows(h, len(h)) + np.uint64(1)) if len(h) else np.zeros(0, np.uint64)


def class_of(u: np.ndarray) -> np.uint64:
    """One number for equal sets."""
    return mix(np.array([mix(u).sum()]) ^ mix(np.array([len(u)])))[0]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of every row of a batch."""
    data, offsets = utf8(batch.column("t"))
    for lo, hi, d, o in slices(data, offsets):
        h, starts, _ = words(d, o)
        at = np.searchsorted(starts, o)
        for k in range(hi - lo):
            yield lo + k, shingles(h[at[k] : at[k + 1]], size)


def _signed(u: list | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(u, np.uint64).view(np.int64))


def sketch(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(id, n, cls, fp): the size of each row's set and its class, null where empty, and the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for k, u in _sets(batch, size):
                n[k] = len(u)
                cls[k] = class_of(u) if len(u) else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(cls.view(np.int64), mask=n == 0), batch.column("fp")], ["id", "n", "cls", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), text_of(text).alias("t"), F.xxhash64(text_of(text)).alias("fp")).transform(in_arrow, run, f"id {kind}, n long, cls long, fp long")


def _tokens(texts: DataFrame, size: int, percent: int | None) -> DataFrame:
    """(token, cls, n) of each text: its prefix by hash, or with no percent the whole set.
    A column ``cls``, if there, must be the text's own class; other texts are left out."""
    named = "cls" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("cls").to_numpy(zero_copy_only=False).view(np.uint64) if named else None
            token, cls, n = [], [], []
            for k, u in _sets(batch, size):
                if not len(u):
                    continue
                c = class_of(u)
                if want is not None and want[k] != c:
                    continue
                token.append(u if percent is None else u[: prefix(len(u), percent) + must_meet(len(u)) - 1])
                cls.append(c)
                n.append(len(u))
            if token:
                many = [len(t) for t in token]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(token)), _signed(np.repeat(np.array(cls, np.uint64), many)), pa.array(np.repeat(n, many).astype(np.int64))], ["token", "cls", "n"])

    return texts.transform(in_arrow, run, "token long, cls long, n long")


def frequent(texts: DataFrame, size: int, sampled: int = SAMPLED, least: int = FREQUENT) -> DataFrame:
    """(token, often): shingles of many classes, the most frequent ones if there are too many, and about how many hold each."""
    some = texts.filter(F.pmod(F.xxhash64("t"), F.lit(sampled)) == 0)
    held = _tokens(some, size, None).select("token", "cls").distinct().groupBy("token").agg(F.count("*").alias("c"))
    most = held.filter(F.col("c") >= least).orderBy(F.desc("c"), "token").limit(MOST_FREQUENT)
    return most.select("token", (F.col("c") * sampled).alias("often"))


def _dealt(rows: DataFrame, hot: DataFrame, tasks: int) -> DataFrame:
    """The rows with ``often``, null for all but frequent tokens, in order by (token, cls); those of
    a token are in one task, of a frequent one only those of a class."""
    marked = rows.join(F.broadcast(hot), "token", "left")
    part = F.when(F.col("often").isNull(), 0).otherwise(F.pmod("cls", F.lit(PARTS)))
    return marked.repartition(tasks, F.col("token"), part).sortWithinPartitions("token", "cls")


def _spread(batch: pa.RecordBatch, names: tuple[str, ...], last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """A batch of ``_dealt``: the rows of other tokens, those of frequent ones without repeats of (token, cls),
    how frequent they are, and the last of them (``last`` is that of the batch before)."""
    rows = np.stack([batch.column(k).to_numpy() for k in names], axis=1)
    often = batch.column("often").fill_null(0).to_numpy()
    own = rows[often > 0]
    if not len(own):
        return rows, own, often[:0], last
    before = np.concatenate([own[:1] - 1 if last is None else last[None], own[:-1]])
    new = (own[:, :2] != before[:, :2]).any(axis=1)
    return rows[often == 0], own[new], often[often > 0][new], own[-1]


def _shared(rows: DataFrame, hot: DataFrame, tasks: int) -> DataFrame:
    """(cls, c): at how many tokens a class meets another one. Runs of equal tokens are read as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, cls, met, last = np.zeros(0, np.int64), np.zeros(0, np.int64), False, None
        for batch in batches:  # the last row of the batch before goes first
            few, many_, _, last = _spread(batch, ("token", "cls"), last)
            if len(many_):
                found, many = np.unique(many_[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many)], ["cls", "c"])
            if not len(few):
                continue
            t, c = np.append(token, few[:, 0]), np.append(cls, few[:, 1])
            meet = np.flatnonzero((t[1:] == t[:-1]) & (c[1:] != c[:-1]))
            opens = np.ones(len(meet), bool)  # the first two classes of a run meet here
            opens[1:] = t[meet[1:]] != t[meet[:-1]]
            if len(meet) and met and t[meet[0]] == t[0]:
                opens[0] = False
            met = (len(meet) > 0 and t[meet[-1]] == t[-1]) or (met and t[0] == t[-1])
            token, cls = t[-1:], c[-1:]
            found, many = np.unique(np.concatenate([c[meet + 1], c[meet[opens]]]), return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(many)], ["cls", "c"])

    dealt = _dealt(rows.select("token", "cls"), hot, tasks)
    return dealt.transform(in_arrow, run, "cls long, c long").groupBy("cls").agg(F.sum("c").alias("c"))


def _counted(rows: DataFrame, hot: DataFrame, tasks: int, most: int = MOST_COUNTED) -> DataFrame:
    """(cls, n, token, df) of the tokens that two classes or more hold, and of all frequent ones; df
    counts classes, up to ``most``, or tells how frequent a frequent one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows (token, cls, n) of the run that may go on; at most ``most``
        full = None  # a token whose run is already longer than that
        last = None  # the last class of that token
        spread = None  # the last row of a frequent token

        def out(rows: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 0]), pa.array(df)], ["cls", "n", "token", "df"])

        def tell(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                _, at, many = np.unique(rows[:, 0], return_index=True, return_counts=True)  # in order already
                df = np.repeat(np.minimum(many, most), many)
                if (keep := df > 1).any():
                    yield out(rows[keep], df[keep])

        for batch in batches:
            rows, own, often, spread = _spread(batch, ("token", "cls", "n"), spread)
            if len(own):
                yield out(own, often)
            if not len(rows):
                continue
            if full is not None:
                own = rows[:, 0] == full
                if own.any():
                    run_, rows = rows[own], rows[~own]
                    new = np.append(run_[0, 1] != last, run_[1:, 1] != run_[:-1, 1])
                    last = run_[-1, 1]
                    if new.any():
                        yield out(run_[new], np.full(int(new.sum()), most))
                if not len(rows):
                    continue
                full = None
            rows = np.concatenate([*held, rows])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            rows = rows[new]
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield from tell(rows[:cut])
            held = [rows[cut:]]
            if len(held[0]) > most:
                yield out(held[0], np.full(len(held[0]), most))
                full, last, held = held[0][0, 0], held[0][-1, 1], []
        if held:
            yield from tell(held[0])

    return _dealt(rows, hot, tasks).transform(in_arrow, run, "cls long, n long, token long, df long")


def _ordered(counted: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(cls, n, tokens, p, second, third): the shared tokens of each class, rare first, how many
    of them are prefix, and as many under two other orders, by hashes of the tokens. Classes
    whose prefix holds no shared token are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def lists(xs: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs)))

        def tell(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            end = np.append(at[1:], len(rows))
            n = rows[at, 1]
            p = prefix(n, percent) - (n - (end - at))
            keep = np.flatnonzero(p > 0)
            if not len(keep):
                return
            tokens, more = [], ([], [])
            for k in keep:
                own = rows[at[k] : end[k], 3]
                tokens.append(own)
                for salt, to in zip(ORDERS, more, strict=True):
                    order = mix(own.view(np.uint64) ^ salt)
                    to.append(np.sort(own[np.argpartition(order, p[k] - 1)[: p[k]]]) if p[k] < len(own) else np.sort(own))
            yield pa.RecordBatch.from_arrays([pa.array(rows[at[keep], 0]), pa.array(n[keep]), lists(tokens), pa.array(p[keep].astype(np.int32)), *map(lists, more)], ["cls", "n", "tokens", "p", "second", "third"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in ("cls", "n", "df", "token")], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if (rows[:, 0] != rows[-1, 0]).any() else 0
            if cut:
                yield from tell(rows[:cut])
            held = rows[cut:]
        if held is not None and len(held):
            yield from tell(held)

    dealt = counted.repartition(tasks, "cls").sortWithinPartitions("cls", "df", "token")
    return dealt.select("cls", "n", "df", "token").transform(in_arrow, run, "cls long, n long, tokens array<long>, p int, second array<long>, third array<long>")


def _verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) that share a prefix token under the other two orders too, and link."""

    def lists(batch: pa.RecordBatch, *names: str) -> list[list[np.ndarray]]:
        parts = [(batch.column(k).values.to_numpy(), batch.column(k).offsets.to_numpy()) for k in names]
        return [[v[o[k] : o[k + 1]] for k in range(batch.num_rows)] for v, o in parts]

    def picked(batch: pa.RecordBatch, good: list[bool], names: list[str]) -> pa.RecordBatch:
        keep = pa.array(np.flatnonzero(good))
        return pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*lists(batch, "sa", "sb", "ra", "rb"), strict=True)
            yield picked(batch, [_meet(sa, sb) and _meet(ra, rb) for sa, sb, ra, rb in sides], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*lists(batch, "ta", "tb"), strict=True)], np.int64)
            yield picked(batch, 100 * common >= percent * (n - common), ["u", "v"])

    def side(k: str, **columns: str) -> DataFrame:
        return known.select(F.col("cls").alias(k), *[F.col(c).alias(f"{s}{k}") for s, c in columns.items()])

    near = pairs.join(side("a", s="second", r="third"), "a").join(side("b", s="second", r="third"), "b").transform(in_arrow, meet, "a long, b long")
    return near.join(side("a", n="n", t="tokens"), "a").join(side("b", n="n", t="tokens"), "b").transform(in_arrow, link, "u long, v long")


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ordered arrays share a value."""
    at = np.searchsorted(b, a)
    return bool((b[np.minimum(at, len(b) - 1)] == a).any())


def _can_link(percent: int):
    """Whether a and b may link if this is the first shingle they share: no more than what
    stands from here on in either can be common. A pair that fails at its first shared
    shingle does not link, and one that does not fail there is found there."""
    return F.expr(f"{100 + percent} * least(ra, rb) >= {percent} * (na + nb)")


def links(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): each row's (id, n, cls, fp), and (cls, root) of the classes that have links."""
    spark = docs.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(sketch(docs, id, text, size), "jaccard-rows")
    bare = docs.select(text_of(text).alias("t"))
    hot = materialize(frequent(bare, size), "jaccard-frequent")
    near = materialize(_shared(_tokens(bare, size, percent), hot, tasks), "jaccard-near")
    enough = F.col("c") >= F.greatest(F.lit(1), F.expr("n div 8"))
    first = rows.filter("cls IS NOT NULL AND id IS NOT NULL").join(near, "cls").filter(enough).groupBy("cls").agg(F.min("id").alias("id"))
    first = small_side(materialize(first, "jaccard-first"))
    texts = docs.select(F.col(id).alias("id"), text_of(text).alias("t")).join(first, "id").select("cls", "t")
    counted = _counted(_tokens(texts, size, None), hot, tasks)
    known = materialize(_ordered(counted, tasks, percent), "jaccard-sets")
    release(near, hot, first)

    alone = (F.col("n") - F.size("tokens")) / F.col("n")  # share of shingles that no other class holds
    met = known.select("cls", "n", alone.alias("q"), F.size("tokens").alias("m"), F.posexplode(F.slice("tokens", F.lit(1), F.col("p"))).alias("k", "token"))
    met = met.select("token", "cls", "n", "q", (F.col("m") - F.col("k")).alias("rest"))

    # the most central class of a token is that of the fewest shingles of its own, as of what others were edited from
    hub = met.groupBy("token").agg(F.min(F.struct("q", "cls", "n", "rest")).alias("hub"))
    pairs = met.join(hub, "token").filter("hub.cls <> cls").select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("hub.cls").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.rest").alias("rb"))
    pairs = pairs.filter(_can_link(percent)).groupBy("a", "b").agg(F.count("*").alias("met"))
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b"))
    edges = materialize(_verified(best, known, percent), "jaccard-links")
    roots = materialize(components(edges).select(F.col("node").alias("cls"), "root"), "jaccard-roots")
    release(edges)
    for _ in range(ROUNDS):
        edges = materialize(_verified(_toward_hubs(met, roots, percent), known, percent), "jaccard-links")
        if not edges.limit(1).count():
            break
        roots = _merged(roots, edges)
        release(edges)
    rest = materialize(_verified(_across(met, roots, percent), known, percent), "jaccard-links")
    merged = _merged(roots, rest)
    release(known, rest)
    return rows, merged


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    return met.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _toward_hubs(met: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with central classes of other components at its tokens: the most
    central one of all, and those of the components that come first and last by a hash."""
    at = _rooted(met, roots)
    hub, turn = F.struct("q", "cls", "n", "rest", "root"), F.xxhash64("root")
    heads = at.groupBy("token").agg(F.min(hub).alias("h1"), F.min_by(hub, F.struct(turn, "q", "cls")).alias("h2"), F.min_by(hub, F.struct(-turn, "q", "cls")).alias("h3"))
    heads = heads.filter("h2.root <> h3.root").select("token", F.array_distinct(F.array("h1", "h2", "h3")).alias("hubs"))
    pairs = at.join(heads, "token").select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "root", F.explode("hubs").alias("hub")).filter("root <> hub.root")
    pairs = pairs.select("a", "na", "ra", F.col("hub.cls").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.rest").alias("rb"))
    return pairs.filter(_can_link(percent)).select("a", "b").distinct()


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components so far and further links, made one."""
    star = roots.filter("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    merged = materialize(components(star.unionByName(edges)).select(F.col("node").alias("cls"), "root"), "jaccard-roots")
    release(roots)
    return merged


def _across(met: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of classes of different components that shares a prefix token.

    Within a token the components are in order, the one with most classes first. A class
    looks up those before its own, and of these only such as may hold a partner by the
    bound on their sizes and places. So there is no pair inside a component.
    """
    at = _rooted(met, roots)
    sizes = at.groupBy("token", "root").agg(F.count("*").alias("c"), F.max("rest").alias("rb"), F.min("n").alias("nb"))
    shared = sizes.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    mixed = sizes.join(shared, "token").withColumn("k", F.struct(-F.col("c"), "root"))
    rows = at.join(mixed.select("token", "root", "k"), ["token", "root"]).select("token", "k", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    near = mixed.select(F.col("token").alias("t"), F.col("k").alias("other"), "rb", "nb")
    seek = rows.join(near, (F.col("token") == F.col("t")) & (F.col("other") < F.col("k")) & _can_link(percent)).select("t", "other", "a", "na", "ra")
    found = rows.select("token", "k", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"))
    pairs = seek.join(found, (F.col("t") == F.col("token")) & (F.col("other") == F.col("k")) & _can_link(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the least id that links reach."""
    return _grouped(docs, id, text, size, percent).select(F.col("id").alias(id), "n_shingles", F.col("first.id").alias("component_id"))


def _grouped(docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """(id, fp, n_shingles, first): each row with the hash of its text, and the least (id, fp) that links reach."""
    rows, roots = links(docs, id, text, size, percent)
    least = rows.filter("cls IS NOT NULL AND id IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "fp")).alias("least"))
    named = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of = named.groupBy("root").agg(F.min("least").alias("first"))
    names = named.join(of, "root").select("cls", "first")
    own = F.when(F.col("id").isNotNull(), F.coalesce("first", F.struct("id", "fp")))
    return rows.join(names, "cls", "left").select("id", "fp", F.col("n").alias("n_shingles"), own.alias("first"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with one row of each group: that of the least id, then of the least hash
    of its text. Rows without id stay. Rows that share an id are judged each by its own text;
    of those that share a text too, the first by a hash of their other columns stays. Only
    such rows move; all others are filtered where they are read."""
    grouped = materialize(_grouped(docs, id, text, size, percent).filter("id IS NOT NULL"), "jaccard-groups")
    i, f, turn = unused(docs, "i", "f", "turn")
    gone = grouped.filter(F.struct("id", "fp") != F.col("first")).select("id", "fp").distinct()
    gone = materialize(gone.select(F.col("id").alias(i), F.col("fp").alias(f)), "jaccard-gone")
    twice = grouped.filter(F.struct("id", "fp") == F.col("first")).groupBy("id", "fp").agg(F.count("*").alias("c")).filter("c > 1")
    twice = materialize(twice.select(F.col("id").alias(i), F.col("fp").alias(f)), "jaccard-twice")
    release(grouped)
    here = (F.col(id) == F.col(i)) & (F.xxhash64(text_of(text)) == F.col(f))
    if not twice.count():
        return docs.join(small_side(gone), here, "left_anti")
    kept = docs.join(small_side(gone), here, "left_anti").join(small_side(twice), here, "left_anti")
    others = [F.col(c) for c in docs.columns if c not in (id, text)]
    again = docs.join(small_side(twice), here, "left_semi").withColumn(turn, F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0))
    once = again.groupBy(F.col(id), F.xxhash64(text_of(text)).alias(f)).agg(F.min_by(F.struct(*docs.columns), turn).alias(i))
    return kept.unionByName(once.select(f"{i}.*"))


def oracle(size: int = WORDS, percent: int = PERCENT) -> str:
    """The result of op3 in DuckDB: all pairs that share a shingle, and a recursive closure of the links."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= {percent} * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
