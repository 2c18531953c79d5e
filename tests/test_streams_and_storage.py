"""The trainer on weighted words, token streams in parts, samples cut at read time, and listings of any store."""

import json
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from millrace.operators import bpe, bpe_rounds
from millrace.operators import tokens as tk
from millrace.plans import token_queries
from millrace.sources import readers, storage, token_bin


def by_library(words, vocab_size, least):
    tok = tk.blank_tokenizer()
    trainer = tokenizers.trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=least, special_tokens=list(tk.SPECIALS), show_progress=False)
    tok.train_from_iterator([" ".join([w] * n) for w, n in words.items()], trainer)
    return json.loads(tok.to_str())["model"]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh", "aé日▁", "éxyz"])
def test_merges_of_weighted_words_equal_the_library(letters):
    r = random.Random(len(letters))
    for _ in range(60):
        words = {"".join(r.choice(letters) for _ in range(r.randrange(1, 12))): r.randrange(1, 30) for _ in range(r.randrange(1, 40))}
        vocab_size, least = r.choice([10, 20, 60, 200]), r.choice([1, 2, 5])
        counts = Counter()
        for w, n in words.items():
            for part in unicodedata.normalize("NFC", w).replace("▁", " ").split():
                counts["▁" + part] += n
        vocab, merges = bpe.learn(list(counts), np.array(list(counts.values())), vocab_size, least, tk.SPECIALS)
        want = by_library(words, vocab_size, least)
        assert vocab == want["vocab"] and [list(m) for m in merges] == want["merges"]


@pytest.mark.parametrize(("letters", "vocab_size", "words"), [("ab", 40, 300), ("abcdefgh", 120, 300), ("aé日▁", 60, 0), ("éxyz", 30, 0)])
def test_merges_by_rounds_equal_those_of_the_driver(spark, monkeypatch, letters, vocab_size, words):
    """Also where guesses are estimated on no more than a few words, and often wrong."""
    monkeypatch.setattr(bpe_rounds, "GUESS_WORDS", max(1, words // 10))
    monkeypatch.setattr(bpe_rounds, "REWRITE", 5)
    r = random.Random(vocab_size)
    counts = {"▁" + "".join(r.choice(letters) for _ in range(r.randrange(1, 12))): r.randrange(1, 30) for _ in range(max(words, 60))}
    counted = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = bpe.learn(list(counts), np.array(list(counts.values())), vocab_size, 2, tk.SPECIALS)
    assert bpe_rounds.learn(counted, vocab_size, 2, tk.SPECIALS) == want and len(want[1]) > 10


def test_many_distinct_words_stay_on_the_executors(spark, monkeypatch):
    lines = spark.createDataFrame([("ab abc abd abe",), ("abc",)], "line string")
    small = tk.train(lines, vocab_size=12).to_str()
    monkeypatch.setattr(tk, "DRIVER_LETTERS", 0)
    monkeypatch.setattr(bpe, "learn", None)  # what holds all words isn't called
    assert tk.train(lines, vocab_size=12).to_str() == small


def test_time_goes_with_words_not_with_their_counts(spark):
    few = spark.createDataFrame([("ab abc",), ("abc",)], "line string")
    assert {r["word"]: r["n"] for r in tk.marked_counts(few).collect()} == {"▁ab": 1, "▁abc": 2}
    vocab, merges = bpe.learn(["▁ab", "▁abc"], np.array([10**15, 10**15 + 1]), 12, 2, tk.SPECIALS)
    assert merges == [("a", "b"), ("▁", "ab"), ("▁ab", "c")] and len(vocab) == 11
    assert bpe.learn([], np.zeros(0, np.int64), 10, 2, tk.SPECIALS) == ({s: k for k, s in enumerate(tk.SPECIALS)}, [])


@pytest.fixture
def numbers(spark):
    docs = spark.range(1000).select("id", F.transform(F.sequence(F.lit(0), (F.col("id") % 7).cast("int")), lambda j: (F.col("id") * 31 + j) % 500).alias("ids"))
    return docs.repartition(6), [(i * 31 + j) % 500 for i in range(1000) for j in range(i % 7 + 1)]


@pytest.fixture
def parts(spark):
    """Range partitions that are not put together again, as they are when they are large."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def mounted(spark, folder):
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{folder.name}.link./in", f"file://{folder}")
    return f"viewfs://{folder.name}/in"


@pytest.mark.parametrize("scheme", ["", "file", "viewfs"])
def test_streams_in_parts(spark, numbers, parts, tmp_path, scheme):
    docs, want = numbers
    root = {"": str(tmp_path), "file": f"file://{tmp_path}"}.get(scheme) or mounted(spark, tmp_path.rename(tmp_path.parent / f"m{random.randrange(10**9)}"))
    path = f"{root}/s"
    assert token_bin.write_stream(docs, path, 500, ["id"]) == (len(want), 1000)
    folder = storage.resolved(spark, path).removeprefix("file://")
    index = json.loads(open(f"{folder}/index.json").read())
    assert len(index["parts"]) > 3 and index["dtype"] == "uint16"
    open(f"{folder}/part-00000001-killed.bin", "wb").write(b"left by a task that was killed")  # not in the index
    assert token_bin.read_bin(spark, path).orderBy("pos").toPandas()["token"].tolist() == want
    for length in (1, 64, 3996, 3997):
        rows = token_bin.read_samples(spark, path, length)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        got = {r["sample_id"]: (r["input_ids"], r["labels"]) for r in rows.collect()}
        assert got == {k: (want[k * length : (k + 1) * length], want[k * length + 1 : (k + 1) * length + 1]) for k in range((len(want) - 1) // length)}
    token_bin.join_parts(spark, path, f"{path}.bin")
    assert np.fromfile(f"{folder}.bin", np.uint16).tolist() == want
    assert token_bin.write_stream(docs.filter("id < 10"), path, 70_000, ["id"])[1] == 10  # in place of the first
    assert token_bin.read_bin(spark, path).orderBy("pos").toPandas()["token"].tolist() == want[: sum(i % 7 + 1 for i in range(10))]


def test_samples_of_partitions_that_end_between_parts(spark, numbers, parts, tmp_path):
    docs, want = numbers
    token_bin.write_stream(docs, str(tmp_path / "s"), 500, ["id"])
    rows = spark.read.format("token_bin").option("path", str(tmp_path / "s")).option("length", 10).option("shard_tokens", 35).load()
    assert rows.rdd.getNumPartitions() > 100
    assert all(r["input_ids"] == want[(a := r["sample_id"] * 10) : a + 10] and r["labels"] == want[a + 1 : a + 11] for r in rows.collect())
    assert token_bin.read_samples(spark, str(tmp_path / "s"), 10).count() == (len(want) - 1) // 10


def test_streams_without_tokens_and_wrong_ids(spark, numbers, tmp_path):
    docs, _ = numbers
    assert token_bin.write_stream(docs.limit(0), str(tmp_path / "e"), 500, ["id"]) == (0, 0)
    assert token_bin.read_bin(spark, str(tmp_path / "e")).count() == token_bin.read_samples(spark, str(tmp_path / "e"), 3).count() == 0
    token_bin.join_parts(spark, str(tmp_path / "e"), str(tmp_path / "e.bin"))
    assert (tmp_path / "e.bin").read_bytes() == b""
    with pytest.raises(Exception, match="outside"):
        token_bin.write_stream(docs, str(tmp_path / "x"), 50, ["id"])
    assert not list((tmp_path / "x").glob("*.bin"))  # what was begun is gone
    with pytest.raises(ValueError, match="length"):
        token_bin.read_samples(spark, str(tmp_path / "e"), 0)


def test_ids_of_over_32_bits(spark, tmp_path):
    want = [0, 1 << 31, (1 << 32) + 5, 1 << 40]
    docs = spark.createDataFrame(list(enumerate([[x] for x in want])), "id long, ids array<long>")
    token_bin.write_stream(docs, str(tmp_path / "s"), (1 << 40) + 1, ["id"])
    assert [r["token"] for r in token_bin.read_bin(spark, str(tmp_path / "s")).orderBy("pos").collect()] == want
    assert [token_bin.choose_dtype(n) for n in (65_535, 65_536, 1 << 32, (1 << 32) + 1)] == ["uint16", "uint32", "uint32", "uint64"]


def test_samples_of_tables_with_many_users(spark, tmp_path):
    spark.range(200).selectExpr("id AS event_id", "id * 1000000 AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    tokens = [i * 31_000_000 + i % 97 for i in range(200)]
    rows = {r["sample_id"]: (r["input_ids"], r["labels"]) for r in token_queries.lm_samples(spark, str(tmp_path)).collect()}
    assert rows == {k: tuple(",".join(map(str, tokens[64 * k + j : 64 * k + 64 + j])) for j in (0, 1)) for k in range(3)}
    assert [r["sample_ids"] for r in token_queries.lm_batches(spark, str(tmp_path)).collect()] == ["0,1,2"]
    assert token_queries.lm_batches_shuffled(spark, str(tmp_path)).count() == 0  # no batch is full


def test_shuffled_batches(spark):
    samples = spark.range(21).withColumnRenamed("id", "sample_id")
    whole = [r["sample_ids"] for r in tk.batches(samples, 4, seed=1).orderBy("batch_id").collect()]
    assert sorted(x for b in whole for x in b) == list(range(21)) and [len(b) for b in whole] == [4] * 5 + [1]
    assert [r["sample_ids"] for r in tk.batches(samples.repartition(3), 4, seed=1, drop_last=True).orderBy("batch_id").collect()] == whole[:5]
    assert whole != [r["sample_ids"] for r in tk.batches(samples, 4, seed=2).orderBy("batch_id").collect()]


@pytest.mark.parametrize("scheme", ["", "viewfs"])
def test_listings(spark, tmp_path, scheme):
    for name in ("b/2.txt", "b/1.TXT", "a.txt", "a b.txt", "c.jsonl", "b/.hidden.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "empty").mkdir()
    root = mounted(spark, tmp_path) if scheme else str(tmp_path)
    rows = {r["path"].rpartition("in/" if scheme else f"{tmp_path}/")[2]: r["length"] for r in storage.listing(spark, root, ".txt").collect()}
    assert rows == {n: len(f"text of {n}") for n in ("a b.txt", "a.txt", "b/1.TXT", "b/2.txt")}
    assert [f.removeprefix(f"{root}/") for f in readers.list_files(root, ".txt", spark)] == sorted(rows)
    assert sorted(r["text"] for r in readers.read_txt(spark, root, "s").collect()) == sorted(f"text of {n}" for n in rows)
    assert sorted(r["line"] for r in readers.read_lines(spark, f"{root}/b").collect()) == ["text of b/1.TXT", "text of b/2.txt"]
    assert readers.read_txt(spark, f"{root}/a.txt", "s").count() == 1
    for path, error in ((f"{root}/c.jsonl", ValueError), (f"{root}/nothing", FileNotFoundError), (f"{root}/empty", FileNotFoundError)):
        with pytest.raises(error):
            readers.list_files(path, ".txt", spark)
    assert [storage.kind(spark, f"{root}/{n}") for n in ("b", "a.txt", "nothing")] == ["folder", "file", None]
