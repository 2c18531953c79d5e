"""The training-data pipeline: language, lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``; rows that a stage rejects are gone for those after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, line_dedup, ngram_join, packing
from millrace.llm.common import materialize, read

TOKENIZER = "word_bpe_49k.json"


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that no result of an operator has, and these by their old names."""
    names = {c: f"c{k}_" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of no language that the labels know: their score
    is nearer to chance than to that of labelled documents that were not learned from.
    Where no row has a label there is nothing to judge by, and all stay."""
    net = language_id.train(docs.filter(~language_id.held_out()))
    if net is None:
        return docs
    plain, names = _plain(docs)
    found = language_id.predict(plain, net, names["doc_id"], names["text"], keep=tuple(c for c in plain.columns if c != names["doc_id"]))
    known = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.least_score(docs, net)))
    return known.select(plain.columns).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier line equals but for one edit, and documents of which no whole line is left."""
    cleaned = line_dedup.clean(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cleaned


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near duplicates."""
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    plain, names = _plain(docs)
    found = decontamination.scan(plain, read(spark, sf_dir, "benchmark", dealt=False), names["doc_id"], names["text"], keep=tuple(c for c in plain.columns if c != names["doc_id"]))
    return found.filter(F.size("hits") == 0).select(plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: The stages train a network, follow links and pack by best fit: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
