"""Tokenizer operators, stream offsets, and fixed-length samples."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pandas as pd
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import nfc as text_nfc
from millrace.operators import bpe, bpe_rounds
from millrace.sources.tables import materialize, release

# Special tokens in the order of their ids, and the word mark.
SPECIALS = ("<|pad|>", "<|unk|>", "<|bos|>", "<|eos|>")
WORD_MARK = "▁"
#: Code points that the library encodes at once.
AT_ONCE = 1 << 17
#: Letters of distinct words from which the driver learns merges.
DRIVER_LETTERS = 1 << 22


def blank_tokenizer() -> tokenizers.Tokenizer:
    """BPE with NFC and word marks, before training."""
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<|unk|>", byte_fallback=True))
    tok.normalizer = tokenizers.normalizers.NFC()
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=WORD_MARK, prepend_scheme="always", split=True)
    tok.decoder = tokenizers.decoders.Metaspace(replacement=WORD_MARK, prepend_scheme="always", split=True)
    return tok


def word_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, n): what a BPE trainer needs of a corpus, counted by the cluster."""
    words = lines.select(F.explode(F.split(F.col(line), " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def marked_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, n) as the tokenizer sees words: in NFC, cut at word marks, each with a mark before it.
    Distinct words are normalized, not their occurrences."""
    plain = F.replace(text_nfc(F.col("word")), F.lit(WORD_MARK), F.lit(" "))
    cut = word_counts(lines, line).select(F.explode(F.split(plain, " ")).alias("word"), "n").filter("word <> ''")
    return cut.groupBy(F.concat(F.lit(WORD_MARK), "word").alias("word")).agg(F.sum("n").alias("n"))


def train(lines: DataFrame, path: str | None = None, vocab_size: int = 32_000, min_frequency: int = 2, line: str = "line") -> tokenizers.Tokenizer:
    """Trains on the words of all lines, which the cluster counts; lines don't reach the driver.

    The merges come from the distinct words and their counts. While these have at most ``DRIVER_LETTERS``
    letters, the driver gets them and learns (``bpe.learn``, about 30 bytes a letter at its peak); beyond that
    they stay on the executors, which count pairs in rounds (``bpe_rounds``): the same merges, and the driver holds
    pairs of symbols. No word is dropped and no count changed.
    """
    if vocab_size <= len(SPECIALS):
        raise ValueError(f"vocab_size must be over {len(SPECIALS)}")
    if min_frequency < 1:
        raise ValueError("min_frequency must be at least 1")
    counted = materialize(marked_counts(lines, line), "words")
    letters = counted.agg(F.sum(F.length("word"))).first()[0]
    if letters is None:
        raise ValueError("there are no lines to train on")
    if letters > DRIVER_LETTERS:
        vocab, merges = bpe_rounds.learn(counted, vocab_size, min_frequency, SPECIALS)
    else:
        words = counted.toArrow()
        vocab, merges = bpe.learn(words.column("word"), words.column("n").to_numpy(), vocab_size, min_frequency, SPECIALS)
    release(counted)
    tok = blank_tokenizer()
    tok.model = tokenizers.models.BPE(vocab=vocab, merges=merges, unk_token=SPECIALS[1], byte_fallback=True)
    tok.add_special_tokens(list(SPECIALS))
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        tok.save(path)
    return tok


def load(path: str) -> tokenizers.Tokenizer:
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return tokenizers.Tokenizer.from_file(path)


def validate(tok: tokenizers.Tokenizer, vocab_size: int) -> int:
    """Checks the size and the specials; returns the id of the end token."""
    if tok.get_vocab_size() != vocab_size:
        raise ValueError(f"the tokenizer has {tok.get_vocab_size()} entries, not {vocab_size}")
    ids = {s: tok.token_to_id(s) for s in ("<|eos|>", "<|unk|>")}
    if None in ids.values():
        raise ValueError("the tokenizer lacks <|eos|> or <|unk|>")
    return ids["<|eos|>"]


def encoder(spark: SparkSession, tok: tokenizers.Tokenizer, eos: int | None = None):
    """An Arrow UDF from texts to ids, with the end id if given; null stays null."""
    sent = spark.sparkContext.broadcast(tok.to_str())
    held: list = []

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if not held:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores; threads of a worker would each keep memory
            held.append(tokenizers.Tokenizer.from_str(sent.value))
        end = [eos] if eos is not None else []
        out: list = [None] * len(texts)
        waiting: list[int] = []
        size = 0
        there = np.flatnonzero(texts.notna().to_numpy()).tolist()
        for n, k in enumerate(there):  # what the library gives is many times as large as its ids: some texts at a time
            waiting.append(k)
            size += len(texts.iat[k])
            if size >= AT_ONCE or n == len(there) - 1:
                for j, e in zip(waiting, held[0].encode_batch([texts.iat[j] for j in waiting]), strict=True):
                    out[j] = np.array(e.ids + end, np.int32)
                waiting, size = [], 0
        return pd.Series(out, index=texts.index, dtype=object)

    return encode.asNondeterministic()


def decoder(spark: SparkSession, tok: tokenizers.Tokenizer):
    sent = spark.sparkContext.broadcast(tok.to_str())

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        t = tokenizers.Tokenizer.from_str(sent.value)
        return ids.map(lambda x: t.decode([int(i) for i in x]), na_action="ignore")

    return decode


def valid_ids(ids: Column, vocab_size: int) -> Column:
    """Whether all ids are inside the vocabulary."""
    return ~F.exists(ids, lambda x: (x < 0) | (x >= vocab_size))


def offsets(docs: DataFrame, size: str, order: list[str], block_rows: int = 100_000) -> DataFrame:
    """Adds offset: the sum of ``size`` over all rows before, in ``order``, by two steps:
    sums of range partitions, then running sums within each. The rows are written down first: they
    are counted, sampled for their ranges and dealt out, and what makes them runs once."""
    rows = materialize(docs, "rows")
    parts = max(1, rows.count() // block_rows)
    if parts == 1:
        return rows.withColumn("offset", F.sum(size).over(Window.orderBy(*order)) - F.col(size))
    cut = materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "offsets")
    release(rows)
    sums = cut.groupBy("part").agg(F.sum(size).alias("s"))
    first = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("first"))
    run = F.sum(size).over(Window.partitionBy("part").orderBy(*order)) - F.col(size)
    return cut.withColumn("run", run).join(F.broadcast(first), "part").withColumn("offset", F.col("first") + F.col("run")).drop("part", "run", "first")


def samples(tokens: DataFrame, length: int, total: int | None = None) -> DataFrame:
    """(sample_id, input_ids, labels) from (pos, token): labels are the inputs one on; the tail is dropped.

    A token goes to the sample it is input of, and where it is the first of one, also to
    the end of the one before; so samples are built by a plain aggregation.
    """
    if length < 1:
        raise ValueError("the sample length must be at least 1")
    n = (total if total is not None else tokens.count()) - 1
    last = n // length
    own = tokens.select(F.expr(f"pos div {length}").alias("sample_id"), F.struct("pos", "token").alias("x"))
    edge = tokens.filter((F.col("pos") % length == 0) & (F.col("pos") > 0)).select(F.expr(f"pos div {length} - 1").alias("sample_id"), F.struct("pos", "token").alias("x"))
    rows = own.unionByName(edge).filter(F.col("sample_id") < last).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]).alias("t"))
    return rows.select("sample_id", F.slice("t", 1, length).alias("input_ids"), F.slice("t", 2, length).alias("labels"))


def batches(samples: DataFrame, batch_size: int, seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """(batch_id, sample_ids): samples by their order, or by a seeded hash of it (MD5 of ``seed|sample_id``)."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if seed is None:  # ids are gapless from 0: they are their own places
        keyed = samples.select("sample_id", F.col("sample_id").alias("k"))
    else:
        shuffled = samples.select("sample_id", F.md5(F.concat_ws("|", F.lit(seed), "sample_id").cast("binary")).alias("h"), F.lit(1).alias("one"))
        keyed = offsets(shuffled, "one", ["h", "sample_id"]).select("sample_id", F.col("offset").alias("k"))
    rows = keyed.groupBy(F.expr(f"k div {batch_size}").alias("batch_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample_id"))), lambda x: x["sample_id"]).alias("sample_ids"))
    return rows.filter(F.size("sample_ids") == batch_size) if drop_last else rows
