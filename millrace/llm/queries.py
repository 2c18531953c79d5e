"""The registered query of each operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_extract import extract_pages

    found = extract_pages(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language_id import held_out, predict, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    net = train(docs.filter(~F.col("held_out")))
    return predict(docs, net, keep=("held_out",))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_join import group

    return group(read(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licenses import scan

    found = scan(read(spark, sf_dir, "documents", dealt=False))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.expr("concat_ws(',', array_sort(array_distinct(transform(notices, n -> n.license))))").alias("licenses"),
        F.expr("round(coalesce(array_max(transform(notices, n -> n.dice)), 0), 6)").alias("best_dice"),
        F.expr("cast(coalesce(array_min(transform(notices, n -> n.line)), -1) as long)").alias("first_line"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_rules import apply, statistics, train

    docs = read(spark, sf_dir, "documents")
    rules = train(docs, read(spark, sf_dir, "labels", dealt=False))
    judged = apply(statistics(docs), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontamination import scan

    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark", dealt=False))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.expr("concat_ws(',', transform(array_sort(transform(hits, h -> h.item)), i -> cast(i as string)))").alias("item_ids"),
        F.expr("round(array_max(transform(hits, h -> h.similarity)), 6)").alias("best_similarity"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_dedup import report

    found = report(read(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.expr("concat_ws(',', transform(dropped, k -> cast(k as string)))"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard

    placed = shard(read(spark, sf_dir, "documents", dealt=False), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_counts import count_tokens

    counted = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import dedup

    return dedup(read(spark, sf_dir, "documents")).drop("kept_text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.prefix_trie import sequences, shared_heads, trie

    return trie(shared_heads(sequences(read(spark, sf_dir, "conversations"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lexical_search import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark", dealt=False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_language_id": op2_language_id,
        "op3_ngram_join": op3_ngram_join,
        "op4_license_scans": op4_license_scans,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontamination": op6_decontamination,
        "op7_line_dedup": op7_line_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_sharding": op9_sharding,
        "op10_token_counts": op10_token_counts,
        "op11_suffix_array_dedup": op11_suffix_array_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    from millrace.llm import lexical_search, licenses, line_dedup, ngram_join, prefix_trie, sharding, suffix_dedup

    return {
        "op3_ngram_join": ngram_join.oracle(),
        "op4_license_scans": licenses.oracle(),
        "op7_line_dedup": line_dedup.oracle(),
        "op9_sharding": sharding.oracle(),
        "op11_suffix_array_dedup": suffix_dedup.oracle(),
        "op12_prefix_trie": prefix_trie.oracle(),
        "op13_lexical_search": lexical_search.oracle(),
    }
