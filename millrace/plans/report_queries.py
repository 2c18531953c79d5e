"""Queries of the reports: statistics, audits, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import dedup, split, stats
from millrace.plans import oracles as o
from millrace.plans.corpus_queries import classified, documents, kept, table
from millrace.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(o.corpus() + """, a AS (SELECT source, count(*) AS input, count(*) FILTER (reason IS NULL) AS kept FROM c GROUP BY source),
x AS (SELECT source, count(*) FILTER (rank > 1) AS duplicates FROM d GROUP BY source), y AS (SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM s GROUP BY source),
m(source, weight) AS (SELECT DISTINCT source, 1 + substr(source, 4)::INTEGER FROM raw UNION ALL SELECT 'absent', 5)
SELECT source, round(weight::DOUBLE / sum(weight) OVER (), 9) AS target_weight, coalesce(input, 0)::BIGINT AS input_docs, coalesce(kept, 0)::BIGINT AS kept_after_filter, coalesce(input - kept, 0)::BIGINT AS filtered,
coalesce(duplicates, 0)::BIGINT AS duplicates, coalesce(train, 0)::BIGINT AS train_docs, coalesce(val, 0)::BIGINT AS val_docs FROM m LEFT JOIN a USING (source) LEFT JOIN x USING (source) LEFT JOIN y USING (source)""")
def source_report(spark, sf_dir):
    """Per-source assembly: the manifest joined to what each stage counted, all from one table without texts."""
    text, stays = F.col("text"), F.col("reason").isNull()
    facts = {"document_id": tx.document_id(F.col("source"), text), "hash": tx.content_hash(text)}
    rows = tables.materialize(classified(spark, sf_dir).select("source", "doc_id", stays.alias("stays"), *[F.when(stays, x).alias(k) for k, x in facts.items()]), "report")
    a = rows.groupBy("source").agg(F.count("*").alias("input_docs"), F.count_if("stays").alias("kept_after_filter"))
    lean = rows.filter("stays")
    firsts = tables.materialize(dedup.places(lean, "hash", ["source", "document_id", "doc_id"], []), "unique")
    x = dedup.counts(lean, firsts).select("source", "duplicates")
    y = split.split(firsts, 0.2).groupBy("source").agg(F.count_if(F.col("split") == "train").alias("train_docs"), F.count_if(F.col("split") == "val").alias("val_docs"))
    names = rows.select("source").distinct().withColumn("weight", 1 + F.substring("source", 4, 9).cast("int"))
    manifest = names.unionByName(spark.createDataFrame([("absent", 5)], "source string, weight int"))
    total = manifest.agg(F.sum("weight").alias("all"))
    out = manifest.crossJoin(F.broadcast(total)).join(a, "source", "left").join(x, "source", "left").join(y, "source", "left")
    out = out.fillna(0).withColumn("filtered", F.col("input_docs") - F.col("kept_after_filter"))
    return out.select("source", F.round(F.col("weight") / F.col("all"), 9).alias("target_weight"), "input_docs", "kept_after_filter", "filtered", "duplicates", "train_docs", "val_docs")


@query("SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS total, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, round(avg(length(text)), 6) AS mean FROM documents GROUP BY source")
def length_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", F.length("text").alias("chars"))
    return rounded(stats.lengths(docs, "chars", ["source"]), "mean", digits=6)


@query(o.corpus() + "SELECT " + ", ".join(f"round(quantile_cont(chars, {p}), 6) AS p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM k")
def length_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(kept(spark, sf_dir), "chars"), "p50", "p90", "p95", "p99", digits=6)


@query("SELECT label, count(*)::BIGINT AS n, round(avg(embedding[1]::DOUBLE), 9) AS mean, round(min(embedding[1]::DOUBLE), 9) AS least, round(max(embedding[1]::DOUBLE), 9) AS most, round(quantile_cont(embedding[1]::DOUBLE, 0.5), 9) AS p50 FROM embeddings GROUP BY label")
def float_stats(spark, sf_dir):
    x = F.get("embedding", F.lit(0)).cast("double")
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.percentile(x, F.lit(0.5)).alias("p50"))
    return rounded(rows, "mean", "least", "most", "p50")


@query(f"SELECT count(*) FILTER (regexp_matches(html, '{tx.HANGUL_SYLLABLE}'))::BIGINT AS hangul, count(*) FILTER (regexp_matches(html, '[A-Za-z]'))::BIGINT AS latin, count(*) FILTER (regexp_matches(html, '[0-9]'))::BIGINT AS digits, count(*) FILTER (regexp_matches(html, '{tx.MATH}'))::BIGINT AS math FROM pages")
def contains_counts(spark, sf_dir):
    return stats.contents(table(spark, sf_dir, "pages"), "html")


@query(f"SELECT doc_id, regexp_matches(text, '{tx.MATH}') AS math, regexp_matches(text, '[0-9]') AS digits, regexp_matches(text, '{tx.HANGUL_SYLLABLE}') AS hangul FROM documents")
def contains_flags(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.has_math(t).alias("math"), tx.has_digit(t).alias("digits"), tx.has_hangul(t).alias("hangul"))


@query("SELECT lang AS language, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def language_stats(spark, sf_dir):
    return rounded(stats.histogram(documents(spark, sf_dir), "language"), "share")


@query(f"SELECT count(*)::BIGINT AS docs, round(avg(({o.english('lang')})::INTEGER), 9) AS english_ratio FROM documents")
def english_ratio(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("docs"), F.round(F.avg(tx.is_english(F.col("language")).cast("int")), 9).alias("english_ratio"))


@query("SELECT quality + 3 AS int_score, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM labels GROUP BY 1 ORDER BY 1")
def score_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("quality") + 3).alias("int_score"))
    return rounded(stats.histogram(rows, "int_score"), "share").orderBy("int_score")


@query("SELECT count(*) FILTER (quality + 3 >= 4)::BIGINT AS at_least_4, count(*) FILTER (quality + 3 = 5)::BIGINT AS exactly_5 FROM labels")
def score_counts(spark, sf_dir):
    s = F.col("quality") + 3
    return table(spark, sf_dir, "labels").agg(F.count_if(s >= 4).alias("at_least_4"), F.count_if(s == 5).alias("exactly_5"))


_WORDS = "len(string_split(text, ' ')) + 1"


def _counted(spark, sf_dir):
    """Documents with a surrogate token count that SQL knows too: words at blanks, and an end token."""
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("chars"), (F.size(F.split("text", " ", -1)) + 1).alias("tokens"))


@query(f"SELECT coalesce((quality + 3)::VARCHAR, 'unknown') AS int_score, count(*)::BIGINT AS docs, round(avg(length(text)), 6) AS avg_chars, round(avg({_WORDS}), 6) AS avg_tokens, round(sum(length(text))::DOUBLE / greatest(sum({_WORDS} - 1), 1), 6) AS chars_per_token FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def score_sample_breakdown(spark, sf_dir):
    rows = _counted(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("int_score", F.coalesce((F.col("quality") + 3).cast("string"), F.lit("unknown")))
    out = rows.groupBy("int_score").agg(F.count("*").alias("docs"), F.avg("chars").alias("avg_chars"), F.avg("tokens").alias("avg_tokens"), (F.sum("chars") / F.greatest(F.sum(F.col("tokens") - 1), F.lit(1))).alias("chars_per_token"))
    return rounded(out, "avg_chars", "avg_tokens", "chars_per_token", digits=6)


@query(f"SELECT count(n_chars)::BIGINT AS docs, round(avg({_WORDS}), 6) AS own_avg, round(avg(n_chars), 6) AS given_avg, round(sum({_WORDS})::DOUBLE / nullif(sum(n_chars), 0), 9) AS ratio FROM documents")
def token_comparison(spark, sf_dir):
    rows = _counted(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").filter("n_chars IS NOT NULL")
    out = rows.agg(F.count("*").alias("docs"), F.avg("tokens").alias("own_avg"), F.avg("n_chars").alias("given_avg"), F.try_divide(F.sum("tokens"), F.sum("n_chars")).alias("ratio"))
    return rounded(rounded(out, "ratio"), "own_avg", "given_avg", digits=6)


_SAMPLE = "SELECT * FROM k ORDER BY sha256('42:' || document_id), document_id LIMIT 100"


@query(o.corpus() + f"SELECT doc_id, document_id FROM ({_SAMPLE})")
def hash_sample(spark, sf_dir):
    return stats.bottom_sample(kept(spark, sf_dir).select("doc_id", "document_id"), "document_id", 100)


@query(o.corpus() + f""", smp AS (SELECT chars, {_WORDS} AS tokens FROM ({_SAMPLE})), f AS (SELECT sum(chars) AS sc, sum(tokens) AS st, count(*) AS sd FROM smp), w AS (SELECT sum(chars) AS kc, count(*) AS kd FROM k),
r AS (SELECT list_sort(list(chars::DOUBLE / (tokens - 1))) AS xs FROM smp WHERE tokens > 1), e AS (SELECT *, sc::DOUBLE / (st - sd) AS cpt, xs[floor((len(xs) - 1) * 0.10)::INTEGER + 1] AS p10, xs[floor((len(xs) - 1) * 0.90)::INTEGER + 1] AS p90 FROM f, w, r),
g AS (SELECT *, round_even(kc / cpt + kd, 0)::BIGINT AS est FROM e), h AS (SELECT *, round_even(kc / p90 + kd, 0)::BIGINT AS lo, round_even(kc / p10 + kd, 0)::BIGINT AS hi, round_even(est * 0.85::DOUBLE, 0)::BIGINT AS fl, round_even(est * 1.15::DOUBLE, 0)::BIGINT AS ce FROM g)
SELECT round(cpt, 9) AS chars_per_token, est AS estimated, CASE WHEN greatest(least(lo, hi), fl) > least(greatest(lo, hi), ce) THEN fl ELSE greatest(least(lo, hi), fl) END AS low, CASE WHEN greatest(least(lo, hi), fl) > least(greatest(lo, hi), ce) THEN ce ELSE least(greatest(lo, hi), ce) END AS high FROM h""")
def token_estimate(spark, sf_dir):
    rows = kept(spark, sf_dir).select("document_id", "chars", (F.size(F.split("text", " ", -1)) + 1).alias("tokens"))
    rows = tables.materialize(rows, "kept")
    sample = stats.bottom_sample(rows, "document_id", 100).select("chars", "tokens")
    return rounded(stats.token_estimate(rows.select("chars"), sample), "chars_per_token")


@query(f"WITH t AS (SELECT sum({_WORDS})::BIGINT AS tokens, sum(strlen(text))::BIGINT AS disk_bytes FROM documents) SELECT tokens, {stats.MODEL_PARAMETERS * stats.TOKENS_PER_PARAMETER}::BIGINT AS needed, greatest(0, {stats.MODEL_PARAMETERS * stats.TOKENS_PER_PARAMETER} - tokens)::BIGINT AS missing, round(tokens::DOUBLE / {stats.MODEL_PARAMETERS * stats.TOKENS_PER_PARAMETER}, 9) AS coverage, round(tokens / (disk_bytes / 1e6), 4) AS tokens_per_mb, round(greatest(0, {stats.MODEL_PARAMETERS * stats.TOKENS_PER_PARAMETER} - tokens) / (tokens / (disk_bytes / 1e6)), 4) AS extra_mb, round(greatest(0, {stats.MODEL_PARAMETERS * stats.TOKENS_PER_PARAMETER} - tokens) / (tokens / (disk_bytes / 1e6)) / (disk_bytes / 1e6 / 2), 4) AS extra_shards FROM t")
def scale_estimate(spark, sf_dir):
    totals = documents(spark, sf_dir).agg(F.sum(F.size(F.split("text", " ", -1)) + 1).alias("tokens"), F.sum(F.octet_length("text")).alias("disk_bytes")).withColumn("files", F.lit(2))
    out = stats.scale_estimate(totals).select("tokens", "needed", "missing", "coverage", "tokens_per_mb", "extra_mb", "extra_shards")
    return rounded(rounded(out, "coverage"), "tokens_per_mb", "extra_mb", "extra_shards", digits=4)


@query("SELECT count(*) FILTER (length(text) >= 10000)::BIGINT AS ge_10k, count(*) FILTER (length(text) >= 50000)::BIGINT AS ge_50k FROM documents")
def long_docs(spark, sf_dir):
    n = F.length("text")
    return documents(spark, sf_dir).agg(F.count_if(n >= 10_000).alias("ge_10k"), F.count_if(n >= 50_000).alias("ge_50k"))


@query(o.corpus() + "SELECT count(*)::BIGINT AS raw_documents, sum(length(raw.text))::BIGINT AS raw_characters, count(*) FILTER (reason IS NULL)::BIGINT AS kept_documents, coalesce(sum(length(c.text)) FILTER (reason IS NULL), 0)::BIGINT AS kept_characters, round(count(*) FILTER (reason IS NULL)::DOUBLE / count(*), 9) AS keep_rate, round(avg(length(c.text)) FILTER (reason IS NULL), 6) AS avg_chars_kept FROM c JOIN raw USING (doc_id)")
def keep_rate(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("raw_chars", F.length("text"))
    from millrace.operators.quality import classify

    rows = classify(docs)
    ok, n = F.col("reason").isNull(), F.length("text")
    out = rows.agg(F.count("*").alias("raw_documents"), F.sum("raw_chars").alias("raw_characters"), F.count_if(ok).alias("kept_documents"), F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).cast("long").alias("kept_characters"))
    out = out.withColumn("keep_rate", F.round(F.coalesce(F.try_divide("kept_documents", "raw_documents"), F.lit(0.0)), 9))
    return out.withColumn("avg_chars_kept", F.round(F.coalesce(F.try_divide("kept_characters", "kept_documents"), F.lit(0.0)), 6))


@query("SELECT doc_id, (doc_id % 3)::BIGINT AS n FROM documents")
def replacement_chars(spark, sf_dir):
    t = F.concat("text", F.repeat(F.lit("�"), (F.col("doc_id") % 3).cast("int")))
    return documents(spark, sf_dir).select("doc_id", tx.replacement_chars(t).cast("long").alias("n"))


@query("SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM documents")
def previews_120(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.preview(F.col("text"), 120).alias("preview"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad, trunc(value)::BIGINT AS whole FROM events")
def safe_casts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.col("event_type").try_cast("double").alias("bad"), F.col("value").cast("long").alias("whole"))


@query("SELECT doc_id, sha256(concat_ws(':', source, lang, 'v1', '42', '0.01')) AS fingerprint, CASE WHEN n_chars <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM documents")
def build_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.concat_ws(":", "source", "lang", F.lit("v1"), F.lit("42"), F.lit("0.01")), 256).alias("fingerprint"), F.when(F.col("n_chars") <= 65_535, "uint16").otherwise("uint32").alias("dtype"))
