"""Byte-pair merges learned on the cluster, in rounds; the result is that of ``bpe.learn``.

The executors hold the distinct words, in blocks of symbols. A round sends them the merges that are
settled and a guess of the next ones; they put these on their words in order and return by how much each
changes the count of each pair, summed up by Spark. The driver replays these exact counts: a guess is
settled as long as it is what they choose, and the rest of it is dropped. The first one always holds.
Guesses start from the exact counts; what they change themselves is estimated on a bounded part of the words. So that
part decides how many rounds there are, never the result. The driver holds pairs of symbols, no words but that part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.bpe import SHIFT, Symbols, letters_of
from millrace.sources.tables import materialize, release

#: Letters of a block, and of a task's blocks, about.
BLOCK, TASK = 1 << 20, 1 << 22
#: Words of either kind (the most frequent ones, some of the others) that guesses are estimated on, and their letters.
GUESS_WORDS, GUESS_LETTERS = 150_000, 32
#: Settled merges after which blocks are written anew, and guesses of a round.
REWRITE, LEAST_GUESSES, MOST_GUESSES = 64, 16, 256
BLOCKS = "symbols binary, sizes binary, counts binary"
Merge = tuple[int, int, int]


class Choice:
    """Names, their ids, the merges so far, and the weights of all pairs: what is merged next."""

    def __init__(self, names: list[str], vocab: dict[str, int], merges: list[tuple[str, str]], weight: dict[int, int], heap: list[tuple[int, int]] | None = None):
        self.names, self.vocab, self.merges, self.weight = names, vocab, merges, weight
        self.heap = [(-n, pair) for pair, n in weight.items()] if heap is None else heap
        if heap is None:
            heapq.heapify(self.heap)

    def copy(self) -> Choice:
        return Choice(self.names.copy(), self.vocab.copy(), [], self.weight.copy(), self.heap.copy())

    def best(self, least: int) -> int | None:
        """The most frequent pair, of equals that of the smaller ids; None where none has ``least`` occurrences."""
        while self.heap:
            n, pair = self.heap[0]
            if -n == self.weight[pair]:
                return pair if -n >= least else None
            heapq.heapreplace(self.heap, (-self.weight[pair], pair))
        return None

    def take(self) -> Merge:
        _, pair = heapq.heappop(self.heap)
        a, b = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
        name = self.names[a] + self.names[b]
        if name not in self.vocab:
            self.vocab[name] = len(self.names)
            self.names.append(name)
        self.merges.append((self.names[a], self.names[b]))
        return a, b, self.vocab[name]

    def change(self, changes: list[tuple[int, int, int]]) -> None:
        """Weights after a merge, from (pair, weight that went, weight that came)."""
        for pair, gone, came in changes:
            self.weight[pair] = self.weight.get(pair, 0) - gone + came
            if came:
                heapq.heappush(self.heap, (-self.weight[pair], pair))


def _merged(text: Symbols, merge: Merge) -> list[tuple[int, int, int]]:
    gone, came = text.merge(*merge, np.flatnonzero(text.symbol == merge[0]).astype(np.int32))
    return [(pair, n, 0) for pair, n in gone] + [(pair, 0, n) for pair, n, _ in came]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Symbols]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            symbols, sizes, counts = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int32, np.int32, np.int64), strict=True))
            if len(symbols):
                yield Symbols(symbols.copy(), sizes, counts)


def _block(symbols: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    kinds = ((symbols, np.int32), (sizes, np.int32), (counts, np.int64))
    return pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in kinds], ["symbols", "sizes", "counts"])


def _alphabet(counted: DataFrame) -> np.ndarray:
    """All code points of the words, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            seen[letters_of(batch.column(0))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["point"])

    found = counted.select("word").mapInArrow(run, "point int").distinct().toArrow()
    return np.sort(found.column("point").to_numpy())


def _blocks(counted: DataFrame, points: np.ndarray, ids: np.ndarray) -> DataFrame:
    """The words as symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            letters, sizes = letters_of(batch.column(0))
            held.append((ids[np.searchsorted(points, letters)], sizes, batch.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield _block(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield _block(*map(np.concatenate, zip(*held, strict=True)))

    return counted.select("word", "n").mapInArrow(run, BLOCKS)


def _rewritten(blocks: DataFrame, settled: list[Merge]) -> DataFrame:
    """The blocks after these merges, without words that are one symbol now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _texts(batches):
            for merge in settled:
                _merged(text, merge)
            live = text.symbol >= 0
            sizes = np.bincount(text.word[live], minlength=len(text.count))
            yield _block(text.symbol[live & (sizes[text.word] > 1)], sizes[sizes > 1], text.count[sizes > 1])

    return blocks.mapInArrow(run, BLOCKS)


def _weights(blocks: DataFrame) -> dict[int, int]:
    """Occurrences of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _texts(batches):
            at = np.flatnonzero(text.after >= 0)
            pairs, of = np.unique(text.symbol[at].astype(np.int64) << SHIFT | text.symbol[text.after[at]], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(of, text.weight(at), len(pairs)).astype(np.int64))], ["pair", "n"])

    found = blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found.column("pair").to_pylist(), found.column("n").to_pylist(), strict=True))


def _changes(blocks: DataFrame, settled: list[Merge], guess: list[Merge]) -> dict[int, list[tuple[int, int, int]]]:
    """(pair, weight that went, weight that came) of each guess, all guesses before it being merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        for text in _texts(batches):
            for merge in settled:
                _merged(text, merge)
            for step, merge in enumerate(guess):
                for pair, gone, came in _merged(text, merge):
                    sums = total[step, pair]
                    sums[0] += gone
                    sums[1] += came
        cols = [[k[0] for k in total], [k[1] for k in total], [x[0] for x in total.values()], [x[1] for x in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["step", "pair", "gone", "came"])

    found = blocks.mapInArrow(run, "step int, pair long, gone long, came long").groupBy("step", "pair").agg(F.sum("gone").alias("gone"), F.sum("came").alias("came")).toArrow()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for step, *change in zip(*(c.to_pylist() for c in found.columns), strict=True):
        out[step].append(tuple(change))
    return out


def _part(counted: DataFrame, words: int, ids: np.ndarray, points: np.ndarray) -> Symbols:
    """The beginnings of the most frequent words and of some of the others, these with higher counts: for guesses alone."""
    short = counted.select(F.substring("word", 1, GUESS_LETTERS).alias("word"), "n")
    top = short.orderBy(F.desc("n")).limit(GUESS_WORDS).toArrow()
    least = min(top.column("n").to_pylist())
    every = max(1, words // GUESS_WORDS)
    rest = short.filter((F.col("n") <= least) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).limit(2 * GUESS_WORDS).toArrow()
    n = top.column("n").to_numpy()
    parts = [(letters_of(t.column("word").combine_chunks()), w, use) for t, w, use in ((top, n, n > least), (rest, rest.column("n").to_numpy() * every, np.ones(len(rest), bool)))]
    letters = np.concatenate([x[0][np.repeat(use, x[1])] for x, _, use in parts])
    return Symbols(ids[np.searchsorted(points, letters)], np.concatenate([x[1][use] for x, _, use in parts]), np.concatenate([w[use] for _, w, use in parts]))


def _guess(choice: Choice, part: Symbols, most: int, vocab_size: int, least: int) -> list[Merge]:
    """The next merges by the exact counts and, for what they change themselves, by the part."""
    choice, part, out = choice.copy(), part.copy(), []
    while len(out) < most and len(choice.names) < vocab_size and choice.best(least) is not None:
        out.append(choice.take())
        choice.change(_merged(part, out[-1]))
    return out


def learn(counted: DataFrame, vocab_size: int, min_frequency: int = 2, specials: tuple[str, ...] = ()) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(vocabulary, merges) of a written table of distinct words (word, n)."""
    spark = counted.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))  # a few blocks at a time
    least = max(1, min_frequency)
    size = counted.agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters")).first()
    points = _alphabet(counted)
    names = list(dict.fromkeys([*specials, *map(chr, points.tolist())]))
    vocab = {x: k for k, x in enumerate(names)}
    ids = np.array([vocab[chr(p)] for p in points.tolist()], np.int32)
    parts = max(spark.sparkContext.defaultParallelism, (size["letters"] or 0) // TASK)
    blocks = materialize(_blocks(counted.repartition(parts), points, ids), "bpe")
    choice, part = Choice(names, vocab, [], _weights(blocks)), _part(counted, size["words"], ids, points)
    settled: list[Merge] = []
    guesses = 2 * LEAST_GUESSES
    while len(names) < vocab_size and (guess := _guess(choice, part, guesses, vocab_size, least)):
        found, held = _changes(blocks, settled, guess), 0
        for a, b, new in guess:
            if choice.best(least) != a << SHIFT | b:
                break
            merge = choice.take()
            choice.change(found.get(held, []))
            _merged(part, merge)
            settled.append(merge)
            held += 1
        guesses = min(MOST_GUESSES, max(LEAST_GUESSES, 2 * held))
        if len(settled) >= REWRITE:
            old, blocks = blocks, materialize(_rewritten(blocks, settled), "bpe")
            release(old)
            settled = []
    release(blocks)
    return vocab, choice.merges
