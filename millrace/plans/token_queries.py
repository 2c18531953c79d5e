"""Queries of the tokenizer, the packed stream, and its samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import tokens as tk
from millrace.plans import oracles as o
from millrace.plans.corpus_queries import documents, unique
from millrace.sources import token_bin
from millrace.sources.tables import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "raw")).select("doc_id", "k", F.trim("raw").alias("line")).filter("line <> ''")


_LINES = "SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents"


@query(f"SELECT doc_id, k::INTEGER AS k, line FROM ({_LINES}) WHERE line <> ''")
def line_scan(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(line, ' ')) AS word FROM ({_LINES}) WHERE line <> '') WHERE word <> '' GROUP BY word")
def tokenizer_word_counts(spark, sf_dir):
    return tk.word_counts(_lines(spark, sf_dir))


def _encoded(spark, sf_dir):
    """Documents encoded by a small tokenizer trained on all of them, with end tokens."""
    tok = tk.train(_lines(spark, sf_dir), vocab_size=1000)
    eos = tok.token_to_id("<|eos|>")
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "source", tk.encoder(spark, tok, eos)(F.col("text")).alias("ids")), eos


@query()
def bpe_encode(spark, sf_dir):
    return _encoded(spark, sf_dir)[0].select("doc_id", "ids")


@query("SELECT doc_id, md5(replace(nfc_normalize(text), chr(10), '')) AS decoded FROM documents WHERE text IS NOT NULL")
def bpe_round_trip(spark, sf_dir):
    """Documents encoded and decoded again. The tokenizer has seen every letter, but no line end: these are unknown to it."""
    tok = tk.train(_lines(spark, sf_dir), vocab_size=1000)
    rows = documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", tk.encoder(spark, tok)(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.md5(tk.decoder(spark, tok)("ids").cast("binary")).alias("decoded"))


@query()
def token_counts(spark, sf_dir):
    rows, _ = _encoded(spark, sf_dir)
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("ids")).alias("tokens"))


@query("SELECT count(*)::BIGINT AS documents, count(*)::BIGINT AS end_tokens, count(*)::BIGINT AS ended FROM documents WHERE text IS NOT NULL")
def eos_invariant(spark, sf_dir):
    """As many end tokens as documents, one at the end of each; ids stay in their rows."""
    rows, eos = _encoded(spark, sf_dir)
    ends = F.size(F.filter("ids", lambda t: t == eos))
    return rows.filter("ids IS NOT NULL").agg(F.count("*").alias("documents"), F.sum(ends).cast("long").alias("end_tokens"), F.count_if(F.element_at("ids", -1) == eos).alias("ended"))


@query(o.corpus() + "SELECT doc_id, n::BIGINT AS n, (sum(n) OVER (ORDER BY source, document_id) - n)::BIGINT AS offset FROM (SELECT *, len(string_split(text, ' ')) + 1 AS n FROM u)")
def pack_offsets(spark, sf_dir):
    rows = unique(spark, sf_dir, n=(F.size(F.split("text", " ", -1)) + 1).cast("long")).select("doc_id", "source", "document_id", "n")
    return tk.offsets(rows, "n", ["source", "document_id"]).select("doc_id", "n", "offset")


_STREAM = "SELECT event_id AS pos, (user_id * 31 + event_id % 97)::BIGINT AS token FROM events"


def _stream(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("pos"), (F.col("user_id") * 31 + F.col("event_id") % 97).cast("long").alias("token"))


def _samples(spark, sf_dir):
    """The stream written in parts, and samples cut where these are read."""
    path, stream = scratch(spark, "lm-stream"), _stream(spark, sf_dir)
    most = stream.agg(F.max("token")).first()[0]  # users are as many as the table has: the vocabulary holds them all
    token_bin.write_stream(stream.select("pos", F.array("token").alias("ids")), path, max(1, (most or 0) + 1), ["pos"])
    return token_bin.read_samples(spark, path, 64)


@query(f"WITH t AS ({_STREAM}), x AS (SELECT pos, token, lead(token) OVER (ORDER BY pos) AS next FROM t) SELECT pos // 64 AS sample_id, string_agg(token::VARCHAR, ',' ORDER BY pos) AS input_ids, string_agg(next::VARCHAR, ',' ORDER BY pos) AS labels FROM x WHERE pos // 64 < ((SELECT count(*) FROM t) - 1) // 64 GROUP BY 1")
def lm_samples(spark, sf_dir):
    return _samples(spark, sf_dir).select("sample_id", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("input_ids", "labels")])


def _batched(batches):
    return batches.select("batch_id", F.concat_ws(",", F.col("sample_ids").cast("array<string>")).alias("sample_ids"))


@query(f"WITH t AS ({_STREAM}) SELECT s // 8 AS batch_id, string_agg(s::VARCHAR, ',' ORDER BY s) AS sample_ids FROM (SELECT unnest(range(((SELECT count(*) FROM t) - 1) // 64)) AS s) GROUP BY 1")
def lm_batches(spark, sf_dir):
    return _batched(tk.batches(_samples(spark, sf_dir), 8))


@query(f"WITH t AS ({_STREAM}), s AS (SELECT s, row_number() OVER (ORDER BY md5('7|' || s), s) - 1 AS k FROM (SELECT unnest(range(((SELECT count(*) FROM t) - 1) // 64)) AS s)) SELECT k // 8 AS batch_id, string_agg(s::VARCHAR, ',' ORDER BY k) AS sample_ids FROM s GROUP BY 1 HAVING count(*) = 8")
def lm_batches_shuffled(spark, sf_dir):
    """A seeded order, without the last batch where it is not full."""
    return _batched(tk.batches(_samples(spark, sf_dir), 8, seed=7, drop_last=True))


@query(f"SELECT count(*) FILTER (token >= 3000)::BIGINT AS invalid FROM ({_STREAM})")
def invalid_ids(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.array("token").alias("ids"))
    return rows.agg(F.count_if(~tk.valid_ids(F.col("ids"), 3000)).alias("invalid"))


@query("SELECT pos, ((pos % 2147483648 * 1103515245 + (42 * 12345) % 2147483648) % 2147483648 * 48271 % 2147483647 % 8000)::BIGINT AS token FROM range(20000) t(pos)")
def synthetic_tokens(spark, sf_dir):
    return token_bin.synthetic_tokens(spark, 20_000, 8000)
