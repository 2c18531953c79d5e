"""Queries of the corpus dataflow: text functions, filters, dedup, split, mix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import dedup, mix, quality, split
from millrace.operators.quality import FilterConfig
from millrace.plans import oracles as o
from millrace.sources import readers, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TIGHT = FilterConfig(min_chars=200, max_chars=5000, min_alpha_hangul_ratio=0.75, max_whitespace_ratio=0.17, max_punct_ratio=0.15, max_repeat_ratio=0.02)


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the corpus dataflow; pruned before they are dealt out."""
    return readers.spread(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("language"), "text"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what normalization removes, by id."""
    tail = F.when(F.col("doc_id") % 4 == 0, "  \r\n \t\n\n\n\nend").when(F.col("doc_id") % 4 == 1, "\x07bell\xa0 \r\nx\x9f").when(F.col("doc_id") % 4 == 2, "é å\r\r\r").otherwise("")
    return documents(spark, sf_dir).withColumn("text", F.concat("text", tail))


DIRTY = "SELECT doc_id, source, lang AS language, text || CASE doc_id % 4 WHEN 0 THEN '  ' || chr(13) || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || 'end' WHEN 1 THEN chr(7) || 'bell' || chr(160) || chr(8195) || chr(13) || chr(10) || 'x' || chr(159) WHEN 2 THEN 'e' || chr(769) || ' a' || chr(778) || chr(13) || chr(13) || chr(13) ELSE '' END AS text FROM documents"


def classified(spark: SparkSession, sf_dir: str, config: FilterConfig = FilterConfig()) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), config)


def kept(spark: SparkSession, sf_dir: str, config: FilterConfig = FilterConfig()) -> DataFrame:
    rows = quality.kept(classified(spark, sf_dir, config))
    return rows.withColumns({"document_id": tx.document_id(F.col("source"), F.col("text")), "chars": F.length("text").cast("long")})


def lean(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """The documents that pass the filters, without their texts: hash, identities, length and ``more`` columns of them."""
    return kept(spark, sf_dir).select("source", "document_id", "doc_id", "chars", tx.content_hash(F.col("text")).alias("hash"), *[c.alias(k) for k, c in more.items()])


def unique(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """(source, document_id, doc_id, chars, ``more``) of the documents that stay after dedup."""
    return dedup.places(lean(spark, sf_dir, **more), "hash", ["source", "document_id", "doc_id"], ["chars", *more])


def parts(spark: SparkSession, sf_dir: str, ratio: float = 0.2) -> DataFrame:
    """The split corpus without its texts, which the dataflow yields once."""
    rows = unique(spark, sf_dir).select("doc_id", "source", "document_id", "chars")
    return split.split(tables.materialize(rows, "unique"), ratio)


@query(o.corpus() + "SELECT source, split, count(*)::BIGINT AS docs, sum(chars)::BIGINT AS chars FROM s GROUP BY ALL")
def corpus_funnel(spark, sf_dir):
    """Normalize, filter, dedup, split, summarize."""
    return parts(spark, sf_dir).groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))


@query(f"SELECT doc_id, {o.normalize('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {o.normalize('text')} AS text FROM ({DIRTY})")
def normalize_dirty(spark, sf_dir):
    return dirty(spark, sf_dir).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query(f"WITH x AS ({DIRTY}) SELECT doc_id, nfc_normalize(text) AS nfc, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS newlines, regexp_replace(text, '{tx.CONTROL}', '', 'g') AS controls, regexp_replace(text, '[{tx.WS}]+\\n', chr(10), 'g') AS line_ends, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS blank_lines, regexp_replace(text, '\\A{tx.SPACE}+|{tx.SPACE}+\\z', '', 'g') AS stripped FROM x")
def normalize_steps(spark, sf_dir):
    t = F.col("text")
    return dirty(spark, sf_dir).select("doc_id", tx.nfc(t).alias("nfc"), tx.unify_newlines(t).alias("newlines"), tx.drop_controls(t).alias("controls"), tx.trim_line_ends(t).alias("line_ends"), tx.collapse_newlines(t).alias("blank_lines"), tx.strip(t).alias("stripped"))


@query(f"SELECT doc_id, {o.normalize('t')} = '' AS is_empty FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS t FROM documents)")
def is_empty(spark, sf_dir):
    t = F.when(F.col("doc_id") % 5 == 0, " \n\t").otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", (tx.normalize(t) == "").alias("is_empty"))


@query("SELECT doc_id, sha256(source || chr(10) || text) AS document_id FROM documents")
def doc_id(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.document_id(F.col("source"), F.col("text")).alias("document_id"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


_RATIOS = (("white", tx.SPACE), ("punct", tx.PUNCTUATION), ("latin", tx.LATIN), ("letters", tx.HANGUL_LATIN))


@query("SELECT page_id, length(html)::BIGINT AS chars, " + ", ".join(f"round({o.ratio('html', p)}, 9) AS {n}" for n, p in _RATIOS) + " FROM pages")
def char_ratios(spark, sf_dir):
    t = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), *[F.round(tx.ratio(t, p), 9).alias(n) for n, p in _RATIOS])


@query(f"WITH x AS ({o.runs('documents')}) SELECT doc_id, coalesce(run, 1)::BIGINT AS run, round(CASE WHEN text = '' THEN 1.0 ELSE coalesce(run, 1)::DOUBLE / length(text) END, 9) AS run_ratio FROM documents LEFT JOIN x USING (doc_id)")
def max_run(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.longest_run(t).cast("long").alias("run"), F.round(tx.run_ratio(t), 9).alias("run_ratio"))


_TAG = "CASE doc_id % 6 WHEN 0 THEN ' EN ' WHEN 1 THEN 'English' WHEN 2 THEN 'en-GB' WHEN 3 THEN NULL WHEN 4 THEN 'eng' ELSE lang END"


@query(f"SELECT doc_id, {o.english('tag')} AS english FROM (SELECT doc_id, {_TAG} AS tag FROM documents)")
def lang_policy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_english(F.expr(_TAG)).alias("english"))


@query(o.corpus() + "SELECT doc_id, reason FROM c")
def filter_reasons(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "reason")


@query(o.corpus(config=TIGHT) + "SELECT doc_id, reason FROM c")
def filter_reasons_tight(spark, sf_dir):
    return classified(spark, sf_dir, TIGHT).select("doc_id", "reason")


_OFF = FilterConfig.of({"min_chars": 100, "enable_repetition": False, "enable_whitespace": False, "max_punct_ratio": 0.03, "enable_alpha_hangul": False, "other": 1})


@query(o.corpus(config=_OFF) + "SELECT doc_id, reason FROM c")
def filter_flags(spark, sf_dir):
    return classified(spark, sf_dir, _OFF).select("doc_id", "reason")


@query(o.corpus("SELECT page_id AS doc_id, 'web' AS source, 'unknown' AS language, html AS text FROM pages", TIGHT) + "SELECT doc_id, reason FROM c")
def filter_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("unknown").alias("language"), F.col("html").alias("text"))
    return quality.classify(pages, TIGHT).select("doc_id", "reason")


@query(o.corpus(config=TIGHT) + "SELECT reason, count(*)::BIGINT AS n FROM c WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC")
def reason_counts(spark, sf_dir):
    return quality.reason_counts(classified(spark, sf_dir, TIGHT)).orderBy(F.desc("n"), "reason")


@query(o.corpus(config=TIGHT) + "SELECT reason, nth, doc_id, preview FROM (SELECT reason, doc_id, replace(substr(text, 1, 80), chr(10), ' ') AS preview, (row_number() OVER (PARTITION BY reason ORDER BY doc_id))::INTEGER AS nth FROM c WHERE reason IS NOT NULL AND text <> '') WHERE nth <= 3")
def reason_previews(spark, sf_dir):
    return quality.previews(classified(spark, sf_dir, TIGHT), ["doc_id"]).select("reason", "nth", "doc_id", "preview")


@query(o.corpus() + "SELECT doc_id, document_id, chars::BIGINT AS chars FROM k")
def kept_docs(spark, sf_dir):
    return kept(spark, sf_dir).select("doc_id", "document_id", "chars")


_JSON = """CASE doc_id % 7 WHEN 0 THEN '{"text": 5}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"content": "x"}' WHEN 3 THEN '{"text": ' WHEN 4 THEN '{"text": null}' ELSE '{"text": "ok ' || doc_id || '", "id": "i"}' END"""
_KINDS = "CASE doc_id % 7 WHEN 0 THEN 'non_string_text' WHEN 1 THEN 'not_object' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'malformed_json' WHEN 4 THEN 'non_string_text' END"


def _json_lines(spark, sf_dir):
    return documents(spark, sf_dir).select(F.lit("f.jsonl").alias("path"), F.col("doc_id").alias("line"), F.expr(_JSON).alias("value"))


@query(f"SELECT doc_id AS line, {_KINDS} || ':f.jsonl:' || doc_id AS error, CASE WHEN doc_id % 7 > 4 THEN 'ok ' || doc_id END AS text FROM documents")
def parse_error_rows(spark, sf_dir):
    return readers.parse_json_lines(_json_lines(spark, sf_dir)).select("line", "error", "text")


@query(f"SELECT doc_id AS line, CASE WHEN json_valid(v) THEN CASE WHEN json_type(v) <> 'OBJECT' THEN 'not_object' WHEN NOT json_exists(v, '$.text') THEN 'missing_field' WHEN json_type(v, '$.text') <> 'VARCHAR' THEN 'non_string_text' END ELSE 'malformed_json' END AS kind FROM (SELECT doc_id, {_JSON} AS v FROM documents)")
def json_classifier(spark, sf_dir):
    return _json_lines(spark, sf_dir).select("line", readers.classify_json(F.col("value")).alias("kind"))


@query(f"SELECT split_part(error, ':', 1) AS kind, count(*)::BIGINT AS n FROM (SELECT {_KINDS} || ':f.jsonl:' || doc_id AS error FROM documents) WHERE error IS NOT NULL GROUP BY 1")
def parse_error_counts(spark, sf_dir):
    rows = readers.parse_json_lines(_json_lines(spark, sf_dir)).filter("error IS NOT NULL")
    return rows.groupBy(tx.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'null_text' END AS error FROM documents")
def parquet_scan_errors(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 9 != 0, F.col("text")))
    return readers.with_errors(docs).select("doc_id", "error")


@query(o.corpus(config=TIGHT) + "SELECT source, count(*)::BIGINT AS input, 0::BIGINT AS parse_errors, count(*) FILTER (reason IS NULL)::BIGINT AS kept_after_filter, count(*) FILTER (reason IS NOT NULL)::BIGINT AS filtered FROM c GROUP BY source")
def ingest_funnel(spark, sf_dir):
    rows = classified(spark, sf_dir, TIGHT).withColumn("error", F.lit(None).cast("string"))
    return rows.groupBy("source").agg(F.count("*").alias("input"), F.count("error").alias("parse_errors"), F.count_if(F.col("reason").isNull()).alias("kept_after_filter"), F.count_if(F.col("reason").isNotNull()).alias("filtered"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables and a source without weight as one union."""
    def one(name, key, source, language, text):
        return readers.spread(table(spark, sf_dir, name)).select(key.alias("doc_id"), F.lit(source).alias("source"), language.alias("language"), text.alias("text"))

    c, unknown = F.col, F.lit("unknown")
    return reduce(DataFrame.unionByName, [
        one("documents", F.concat(F.lit("d"), "doc_id"), "docs", c("lang"), c("text")),
        one("conversations", F.concat(F.lit("c"), "conv_id", F.lit("."), "turn"), "chat", unknown, c("text")),
        one("benchmark", F.concat(F.lit("b"), "item_id"), "bench", F.lit("en"), c("text")),
        one("pages", F.concat(F.lit("p"), "page_id"), "web", unknown, c("html")),
        one("benchmark", F.concat(F.lit("x"), "item_id"), "unweighted", F.lit("en"), F.concat("text", F.lit(" again"))),
    ])


def mixed_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.kept(quality.classify(mixed_sources(spark, sf_dir)))
    rows = rows.withColumns({"document_id": tx.document_id(F.col("source"), F.col("text")), "chars": F.length("text").cast("long")})
    rows = dedup.places(rows.withColumn("hash", tx.content_hash(F.col("text"))), "hash", ["source", "document_id", "doc_id"], ["chars"]).select("source", "document_id", F.lit(0).alias("ord"), "chars")
    train = split.split(tables.materialize(rows, "unique"), 0.01).filter("split = 'train'").drop("split")
    return tables.materialize(train, "train")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(o.WEIGHTS, "source string, weight double")


@query(f"SELECT source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM ({o.MIXED}) GROUP BY source")
def union_sources(spark, sf_dir):
    return mixed_sources(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(o.corpus() + "SELECT doc_id, document_id FROM u")
def exact_dedup(spark, sf_dir):
    return unique(spark, sf_dir).select("doc_id", "document_id")


@query(o.corpus() + "SELECT doc_id, rank::INTEGER AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rank FROM k)")
def dedup_by_arrival(spark, sf_dir):
    return dedup.ranked(kept(spark, sf_dir), ["doc_id"]).select("doc_id", "rank")


_STATS = "count(*)::BIGINT AS seen, count(*) FILTER (rank = 1)::BIGINT AS kept, count(*) FILTER (rank > 1)::BIGINT AS duplicates FROM d"


def dedup_counts(spark, sf_dir):
    """Seen, kept and duplicates by source, from one table of hashes."""
    rows = tables.materialize(lean(spark, sf_dir).drop("chars"), "lean")
    return dedup.counts(rows, dedup.places(rows, "hash", ["source", "document_id", "doc_id"], []))


@query(o.corpus() + f"SELECT source, {_STATS} GROUP BY source")
def dedup_stats(spark, sf_dir):
    return dedup_counts(spark, sf_dir)


@query(o.corpus() + f"SELECT source, {_STATS} GROUP BY ROLLUP (source)")
def dedup_rollup(spark, sf_dir):
    return dedup_counts(spark, sf_dir).rollup("source").agg(*[F.sum(c).alias(c) for c in ("seen", "kept", "duplicates")])


@query(o.corpus() + "SELECT sha256(text) AS hash, min(source) FILTER (rank = 1) AS winner, count(DISTINCT source)::BIGINT AS sources FROM d GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_winner(spark, sf_dir):
    first = F.min(F.struct("source", "document_id", "doc_id"))
    rows = lean(spark, sf_dir).groupBy("hash").agg(first.alias("first"), F.size(F.collect_set("source")).cast("long").alias("sources"))
    return rows.filter("sources > 1").select("hash", F.col("first.source").alias("winner"), "sources")


@query(f"SELECT doc_id, {o.bucket('id')} AS bucket, CASE WHEN {o.bucket('id', 7)} < 1234 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, sha256(source || chr(10) || text) AS id FROM documents)")
def split_assign(spark, sf_dir):
    i = tx.document_id(F.col("source"), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", split.bucket(i).alias("bucket"), split.assign(i, 0.1234, 7).alias("split"))


@query(o.corpus() + "SELECT split, count(*)::BIGINT AS n FROM s GROUP BY split")
def split_counts(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


def _sided(spark, sf_dir, val: bool):
    """Documents that all hash to one side at a ratio, so that the fallback must move one."""
    rows = tables.materialize(unique(spark, sf_dir).select("doc_id", "source", "document_id"), "unique")
    at = split.bucket(F.col("document_id"))
    return rows.filter(at < 2000 if val else at >= 2000)


@query(o.corpus() + f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY source, document_id) = 1 THEN 'train' ELSE 'val' END AS split FROM u WHERE {o.bucket('document_id')} < 2000")
def split_fallback_train(spark, sf_dir):
    return split.split(_sided(spark, sf_dir, True), 0.2).select("doc_id", "split")


@query(o.corpus() + f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY source, document_id) = 1 THEN 'val' ELSE 'train' END AS split FROM u WHERE {o.bucket('document_id')} >= 2000")
def split_fallback_val(spark, sf_dir):
    return split.split(_sided(spark, sf_dir, False), 0.2).select("doc_id", "split")


@query(o.corpus() + "SELECT count(*)::BIGINT AS n FROM (SELECT document_id FROM s WHERE split = 'train' INTERSECT SELECT document_id FROM s WHERE split = 'val')")
def split_overlap(spark, sf_dir):
    return split.overlap(parts(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(o.corpus() + "SELECT doc_id FROM s WHERE split = 'train' AND doc_id NOT IN (SELECT min(doc_id) FROM s WHERE split = 'train')")
def all_but_one(spark, sf_dir):
    train = parts(spark, sf_dir).filter("split = 'train'").select("doc_id")
    return train.join(train.agg(F.min("doc_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT source, round(weight / sum(weight) OVER (), 9) AS target_weight FROM (VALUES " + ", ".join(f"('{n}', {w}::DOUBLE)" for n, w in o.WEIGHTS) + ") AS w(source, weight)")
def weight_norm(spark, sf_dir):
    return mix.normalized_weights(weights(spark)).select("source", F.round("target_weight", 9).alias("target_weight"))


@query(o.mixed(1) + "SELECT source, document_id, pass::INTEGER AS pass FROM m")
def mix_first_pass(spark, sf_dir):
    return mix.mix(mixed_train(spark, sf_dir), weights(spark), 1).select("source", "document_id", "pass")


@query(o.mixed(3) + "SELECT source, document_id, pass::INTEGER AS pass FROM m")
def mix_oversample(spark, sf_dir):
    return mix.mix(mixed_train(spark, sf_dir), weights(spark), 3).select("source", "document_id", "pass")


@query(o.mixed(3) + """, a AS (SELECT source, sum(chars) AS c, count(*) AS n, max(pass) AS rp FROM m GROUP BY source), pool AS (SELECT source, count(*) AS un FROM t GROUP BY source)
SELECT source, round(g.target_weight, 9) AS target_weight, floor(g.target)::BIGINT AS target_chars, coalesce(c, 0)::BIGINT AS actual_chars, coalesce(n, 0)::BIGINT AS docs, coalesce(un, 0)::BIGINT AS unique_docs,
coalesce(rp, 0)::BIGINT AS repeat_passes, round(coalesce(c, 0)::DOUBLE / greatest(sum(c) OVER (), 1), 9) AS actual_char_ratio FROM g LEFT JOIN a USING (source) LEFT JOIN pool USING (source)""")
def mix_stats(spark, sf_dir):
    train = mixed_train(spark, sf_dir)
    rows = mix.stats(train, weights(spark), mix.mix(train, weights(spark), 3))
    return rows.withColumns({c: F.round(c, 9) for c in ("target_weight", "actual_char_ratio")})


@query(o.mixed(2) + "SELECT (row_number() OVER (ORDER BY source, pass, document_id) - 1)::BIGINT AS place, source, document_id FROM m")
def mix_order(spark, sf_dir):
    from millrace.operators.tokens import offsets

    rows = mix.mix(mixed_train(spark, sf_dir), weights(spark), 2).withColumn("one", F.lit(1))
    return offsets(rows, "one", ["source", "pass", "document_id"]).select(F.col("offset").alias("place"), "source", "document_id")


@query(o.corpus() + "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM raw) WHERE rn <= 150")
def max_documents(spark, sf_dir):
    from millrace.operators import limit

    return limit.first(documents(spark, sf_dir).select("source", "doc_id"), 150, ["source"], "doc_id").select("doc_id")


@query(o.corpus() + "SELECT (row_number() OVER (ORDER BY source, document_id) - 1)::BIGINT AS place, doc_id FROM u")
def document_order(spark, sf_dir):
    from millrace.operators.tokens import offsets

    rows = unique(spark, sf_dir).select("source", "document_id", "doc_id").withColumn("one", F.lit(1))
    return offsets(rows, "one", ["source", "document_id"]).select(F.col("offset").alias("place"), "doc_id")


@query(o.corpus() + "SELECT DISTINCT source FROM u")
def source_names(spark, sf_dir):
    return unique(spark, sf_dir).select("source").distinct()
