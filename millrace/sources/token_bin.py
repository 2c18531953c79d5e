"""Token streams as headerless binary: part files with an index, or one file.

A stream lies in a folder of parts and an ``index.json`` that names them in order with their
lengths. Tasks write parts under names of their own; the index is written when all are done, and
what it doesn't name doesn't count: a task that is killed or runs twice leaves the stream whole. Readers cut
the stream where they need it, whatever parts there are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from millrace.sources.storage import resolved

#: Largest vocabularies whose ids are stored in 16 and in 32 bits.
MOST_U16, MOST_U32 = 65_535, 1 << 32
#: Tokens of an input partition, and of a batch of rows.
SHARD_TOKENS, BATCH_TOKENS = 4_000_000, 1 << 18
INDEX = "index.json"


def choose_dtype(vocab_size: int) -> str:
    if vocab_size < 1:
        raise ValueError("vocab_size must be positive")
    return "uint16" if vocab_size <= MOST_U16 else "uint32" if vocab_size <= MOST_U32 else "uint64"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path there; one without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _is_folder(path: str) -> bool:
    store, at = _opened(path)
    return store.get_file_info(at).type == pafs.FileType.Directory


def _read_json(path: str) -> dict:
    store, at = _opened(path)
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class _Part(WriterCommitMessage):
    part: int
    file: str
    tokens: int
    docs: int


class _BinWriter(DataSourceArrowWriter):
    """Writes the rows of a column of ids, one part for each task."""

    def __init__(self, options: dict):
        self.path, self.vocab_size = options["path"], int(options["vocab_size"])
        self.dtype = choose_dtype(self.vocab_size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        store, folder = _opened(self.path)
        part = TaskContext.get().partitionId()
        name, tokens, docs = f"part-{part:08d}-{uuid.uuid4().hex}.bin", 0, 0
        store.create_dir(folder, recursive=True)
        try:
            with store.open_output_stream(f"{folder}/{name}") as out:
                for batch in iterator:
                    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                    if len(flat) and (flat.min() < 0 or flat.max() >= self.vocab_size):
                        raise ValueError(f"a token id is outside 0..{self.vocab_size - 1}")
                    out.write(flat.astype(self.dtype).tobytes())
                    tokens, docs = tokens + len(flat), docs + batch.num_rows
        except BaseException:
            store.delete_file(f"{folder}/{name}")
            raise
        return _Part(part, name, tokens, docs)

    def commit(self, messages: list[_Part | None]) -> None:
        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        parts = [[m.file, m.tokens, m.docs] for m in sorted((m for m in messages if m), key=lambda m: m.part)]
        with store.open_output_stream(f"{folder}/{INDEX}.tmp") as out:
            out.write(json.dumps({"dtype": self.dtype, "parts": parts}).encode())
        store.move(f"{folder}/{INDEX}.tmp", f"{folder}/{INDEX}")
        named = {p[0] for p in parts}
        for f in store.get_file_info(pafs.FileSelector(folder)):  # of earlier writes, and of tasks that were killed
            if f.base_name.startswith("part-") and f.base_name not in named:
                store.delete_file(f.path)

    def abort(self, messages: list[_Part | None]) -> None:
        store, folder = _opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.file}")


class Stream:
    """The tokens of a folder of parts, or of one file that ``metadata`` describes."""

    def __init__(self, path: str, metadata: str | None = None):
        self.path = path
        if _is_folder(path):
            index = _read_json(f"{path}/{INDEX}")
            self.dtype, parts = np.dtype(index["dtype"]), [(f"{path}/{name}", n) for name, n, _ in index["parts"]]
            self.docs = sum(p[2] for p in index["parts"])
        else:
            meta = _read_json(metadata or f"{path.rpartition('/')[0] or '.'}/metadata.json")
            split = next((s for s in ("train", "val") if meta.get(f"{s}_bin") == path.rpartition("/")[2]), None)
            self.dtype, parts = np.dtype(meta["dtype"]), [(path, meta[f"{split}_tokens"] if split else meta["token_count"])]
            self.docs = None
        for name, n in parts:
            store, at = _opened(name)
            have = store.get_file_info(at).size
            if have != n * self.dtype.itemsize:
                raise ValueError(f"{name} has {have} bytes, not {n} tokens of {self.dtype}")
        self.parts = [(name, n) for name, n in parts if n]
        self.ends = np.cumsum([n for _, n in self.parts], dtype=np.int64)
        self.tokens = int(self.ends[-1]) if self.parts else 0

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The tokens from lo to hi, wherever parts begin."""
        out, size = [np.zeros(0, self.dtype)], self.dtype.itemsize
        for k in range(int(np.searchsorted(self.ends, lo, "right")), len(self.parts)):
            name, n = self.parts[k]
            first = int(self.ends[k]) - n
            a, b = max(lo, first) - first, min(hi, first + n) - first
            if a >= b:
                break
            store, at = _opened(name)
            with store.open_input_file(at) as f:
                out.append(np.frombuffer(f.read_at((b - a) * size, a * size), self.dtype))
        return np.concatenate(out)


@dataclass
class _Range(InputPartition):
    lo: int
    hi: int


class _BinReader(DataSourceReader):
    """Rows (pos, token); with a ``length`` samples, whose partitions begin and end between samples:
    each also reads the one token after its last, the label of that."""

    def __init__(self, options: dict):
        self.stream = Stream(options["path"], options.get("metadata"))
        self.length = int(options.get("length") or 0)
        step = int(options.get("shard_tokens") or SHARD_TOKENS)
        self.rows = max(0, self.stream.tokens - 1) // self.length if self.length else self.stream.tokens
        self.step = max(1, step // self.length) if self.length else step

    def partitions(self) -> list[InputPartition]:
        return [_Range(lo, min(lo + self.step, self.rows)) for lo in range(0, self.rows, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        size = self.length or 1
        step = max(1, BATCH_TOKENS // size)
        for lo in range(partition.lo, partition.hi, step):
            hi = min(lo + step, partition.hi)
            if not self.length:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(self.stream.read(lo, hi).astype(np.int64))], ["pos", "token"])
                continue
            found = self.stream.read(lo * size, hi * size + 1).astype(np.int64)
            edges = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * size)
            lists = [pa.ListArray.from_arrays(edges, pa.array(part)) for part in (found[:-1], found[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), *lists], ["sample_id", "input_ids", "labels"])


class TokenBin(DataSource):
    """``spark.read.format("token_bin").option("path", ...)``: rows (pos, token), or with the option ``length``
    (sample_id, input_ids, labels). It also writes a column of ids, with the option ``vocab_size``."""

    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def schema(self) -> str:
        return "sample_id long, input_ids array<long>, labels array<long>" if self.options.get("length") else "pos long, token long"

    def reader(self, schema) -> DataSourceReader:
        return _BinReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BinWriter(self.options)


def _scan(spark: SparkSession, path: str, metadata: str | None, **options: int) -> DataFrame:
    spark.dataSource.register(TokenBin)
    reader = spark.read.format("token_bin").option("path", resolved(spark, path)).options(**options)
    return (reader.option("metadata", resolved(spark, metadata)) if metadata else reader).load()


def read_bin(spark: SparkSession, path: str, metadata: str | None = None) -> DataFrame:
    """(pos, token) of a stream in parts or in one file."""
    return _scan(spark, path, metadata)


def read_samples(spark: SparkSession, path: str, length: int, metadata: str | None = None) -> DataFrame:
    """(sample_id, input_ids, labels): labels are the inputs one on; the tail is dropped. Samples are cut
    where they are read: no row of a single token, and no shuffle."""
    if length < 1:
        raise ValueError("the sample length must be at least 1")
    return _scan(spark, path, metadata, length=length)


def write_stream(docs: DataFrame, path: str, vocab_size: int, order: list[str], ids: str = "ids") -> tuple[int, int]:
    """Writes the ids of all documents in ``order`` as parts of one stream: (tokens, documents). An id
    outside the vocabulary is an error. A stream that was there is replaced."""
    choose_dtype(vocab_size)
    spark = docs.sparkSession
    spark.dataSource.register(TokenBin)
    where = resolved(spark, path)
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(ids)
    rows.write.format("token_bin").mode("append").option("path", where).option("vocab_size", vocab_size).save()
    done = Stream(where)
    return done.tokens, done.docs


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One file of all parts of a stream. On a file system the executors copy each part to its place;
    in a store without writes at a place the driver streams them, 16 MB at a time."""
    stream, size = Stream(resolved(spark, folder)), 1 << 24
    where = resolved(spark, target)
    store, at = _opened(where)
    temp = f"{at}.{uuid.uuid4().hex}.tmp"
    local = isinstance(store, pafs.LocalFileSystem)
    if local and stream.parts:
        with open(temp, "wb") as f:
            f.truncate(stream.tokens * stream.dtype.itemsize)
        starts = (np.append(0, stream.ends[:-1]) * stream.dtype.itemsize).tolist()

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, path = _opened(name)
                    with own.open_input_stream(path) as f, open(temp, "r+b") as out:
                        out.seek(first)
                        while chunk := f.read(size):
                            out.write(chunk)
                yield batch

        places = spark.createDataFrame([(name, first) for (name, _), first in zip(stream.parts, starts, strict=True)], "name string, first long")
        places.repartition(min(len(starts), 1024)).mapInArrow(copy, "name string, first long").count()
    else:
        with store.open_output_stream(temp) as out:
            for name, _ in stream.parts:
                own, path = _opened(name)
                with own.open_input_stream(path) as f:
                    while chunk := f.read(size):
                        out.write(chunk)
    store.move(temp, at)


def write_bin(docs: DataFrame, path: str, vocab_size: int, order: list[str], ids: str = "ids") -> tuple[int, int]:
    """``write_stream`` as one file, for readers that map it: (tokens, documents)."""
    spark = docs.sparkSession
    folder = f"{path}.parts"
    counts = write_stream(docs, folder, vocab_size, order, ids)
    join_parts(spark, folder, path)
    store, at = _opened(resolved(spark, folder))
    store.delete_dir(at)
    return counts


def synthetic_tokens(spark, n: int, vocab_size: int, seed: int = 42) -> DataFrame:
    """(pos, token): uniform ids by an arithmetic hash, the same in any engine."""
    mixed = (F.col("id") % 2_147_483_648 * 1_103_515_245 + (seed * 12_345) % 2_147_483_648) % 2_147_483_648
    return spark.range(n).select(F.col("id").alias("pos"), ((mixed * 48_271 % 2_147_483_647) % vocab_size).alias("token"))


def synthetic_bins(spark, out: str, vocab_size: int, train_tokens: int, val_tokens: int, seed: int = 42) -> dict:
    """Two streams and their metadata, for smoke tests of a trainer."""
    Path(out).mkdir(parents=True, exist_ok=True)
    for k, (name, n) in enumerate((("train", train_tokens), ("val", val_tokens))):
        stream = synthetic_tokens(spark, n, vocab_size, seed + k).select("pos", F.array("token").alias("ids"))
        write_bin(stream, f"{out}/{name}.bin", vocab_size, ["pos"])
    meta = {"tokenizer": None, "vocab_size": vocab_size, "dtype": choose_dtype(vocab_size), "train_tokens": train_tokens, "val_tokens": val_tokens, "eos_token_id": 3, "validation_ratio": None, "seed": seed, "num_train_documents": 1, "num_val_documents": 1, "train_bin": "train.bin", "val_bin": "val.bin", "synthetic": True}
    Path(out, "metadata.json").write_text(json.dumps(meta, indent=2) + "\n")
    return meta
