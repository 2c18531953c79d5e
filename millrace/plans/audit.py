"""Corpus audits: one report on a source, its tokens counted or estimated from a sample."""

from __future__ import annotations

import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import dedup, limit, quality, stats, tokens
from millrace.operators.quality import FilterConfig
from millrace.plans.build import PIPELINE_VERSION, sha256_file, write_json
from millrace.sources import readers
from millrace.sources.storage import listing
from millrace.sources.tables import materialize, release


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def _of(key: str) -> Column:
    return F.element_at("prov", F.lit(key))


def scan(raw: DataFrame, config: FilterConfig, max_documents: int | None = None) -> DataFrame:
    """One row for each row of the source: what the report needs of it, and the text of what is kept."""
    if max_documents is not None:
        inside = limit.cut_off(raw.filter("error IS NULL").select("path", "ord"), max_documents, ["path"], "ord")
        raw = raw if inside is None else raw.filter(F.col("error").isNotNull() | inside)
    sized = raw.withColumns({"raw_chars": F.length("text").cast("long"), "bad_chars": tx.replacement_chars(F.col("text")).cast("long")})
    rows = quality.classify(sized, config)
    text, stays = F.col("text"), F.col("error").isNull() & F.col("reason").isNull()
    holds = {f"has_{k}": F.when(stays, f(text)) for k, f in (("hangul", tx.has_hangul), ("latin", tx.has_latin), ("digits", tx.has_digit), ("math", tx.has_math))}
    return rows.select(
        "path", "ord", "prov", tx.error_kind(F.col("error")).alias("error"), "raw_chars", "bad_chars", F.when(F.col("error").isNull(), F.col("reason")).alias("reason"),
        F.when(stays, tx.document_id(F.col("source"), text)).alias("document_id"), F.when(stays, tx.content_hash(text)).alias("hash"), F.when(stays, F.length(text).cast("long")).alias("chars"),
        *[v.alias(k) for k, v in holds.items()], F.when(stays, text).alias("text"),
    ).withColumn("row", F.monotonically_increasing_id())


def _spread_of(value: str, *points: int) -> list[Column]:
    """Count, sum, extremes, mean and exact percentiles of a column, as columns of one aggregate."""
    x = F.col(value)
    out = [F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0)).cast("long").alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean")]
    return out + [F.percentile(x, F.lit(p / 100)).cast("double").alias(f"p{p:02d}") for p in points]


def _languages(rows: DataFrame) -> dict | None:
    """Counts of the language field, the share of English, and the language score; None without either."""
    use = rows.filter("error IS NULL")
    by = use.filter(_of("language").isNotNull()).groupBy(_of("language").alias("l")).agg(F.count("*").alias("n"), F.first(tx.is_english(_of("language"))).alias("en")).collect()
    score = _row(use.select(_of("language_score").try_cast("double").alias("s")).agg(*_spread_of("s", 5, 10, 50)))
    if not by and not score["n"]:
        return None
    total = sum(r["n"] for r in by)
    scores = {"count": score["n"], "mean": score["mean"], "median": score["p50"], "p05": score["p05"], "p10": score["p10"], "minimum": score["least"], "maximum": score["most"]}
    return {"documents_with_language_field": total, "language_counts": {r["l"]: r["n"] for r in sorted(by, key=lambda r: r["l"])}, "english_ratio": sum(r["n"] for r in by if r["en"]) / total if total else 0.0, "language_score": scores, "note": "Sanity only; not used for filtering or deletion."}


def _education(rows: DataFrame, counted: DataFrame) -> dict | None:
    """Counts of the education score and what the sample holds of each; None without scores."""
    scores = rows.filter("error IS NULL").select(F.floor(_of("int_score").try_cast("double")).cast("long").alias("s")).filter("s IS NOT NULL")
    by = {r["s"]: r["n"] for r in scores.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()}
    if not by:
        return None
    total = sum(by.values())
    at_least_4 = sum(n for s, n in by.items() if s >= 4)
    sample = counted.groupBy(F.coalesce(_of("int_score"), F.lit("unknown")).alias("int_score")).agg(F.count("*").alias("documents"), F.avg("chars").alias("average_chars"), F.avg("tokens").alias("average_tokens"), F.try_divide(F.sum("chars").cast("double"), F.sum(F.col("tokens") - 1)).alias("chars_per_token"))
    return {
        "documents_with_int_score": total, "by_int_score": {str(s): {"documents": n, "ratio": n / total} for s, n in by.items()}, "score_ge_4_documents": at_least_4, "score_ge_4_ratio": at_least_4 / total,
        "int_score_5_documents": by.get(5, 0), "int_score_5_ratio": by.get(5, 0) / total, "sample_by_int_score": [r.asDict() for r in sample.orderBy("int_score").collect()], "note": "No score threshold applied in this audit.",
    }


def audit(
    spark: SparkSession, path: str, fmt: str, source: str, tokenizer: str, output: str | None = None, language: str | None = None, text_field: str = "text", min_chars: int = 32,
    sample_documents: int = 10_000, seed: int = 42, full: bool = False, max_documents: int | None = None, preview_count: int = 0, layout: str = "general",
) -> dict:
    """Profiles a source. ``full`` encodes every kept document; else a seeded sample is encoded
    and the total estimated. Lengths, percentiles and long documents are exact either way.

    The source is read once: a pass writes down what the report needs of each row, and its sums come with that
    pass. The rest are aggregates over columns beside the texts; texts are read again to be encoded. ``layout``:
    general, or scale (a full audit's, with the coverage of a model's need)."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; there are {', '.join(LAYOUTS)}")
    began = time.perf_counter()
    full = full or layout == "scale"
    listed = listing(spark, path, readers.FORMATS[fmt.lower()]).select("path", "length").orderBy("path").collect()
    tok = tokens.load(tokenizer)
    eos = tok.token_to_id("<|eos|>")
    raw = readers.read_source(spark, path, source, fmt, language, text_field)
    columns = readers.columns_of(spark, path) if fmt.lower() == "parquet" else [text_field]
    config = FilterConfig(min_chars=min_chars)

    seen = Observation("audit")
    good, given = F.col("error").isNull(), _of("token_count").try_cast("long")
    rows = scan(raw, config, max_documents).observe(
        seen, F.count_if(good).alias("raw"), F.coalesce(F.sum(F.when(good, F.col("raw_chars"))), F.lit(0)).alias("raw_chars"), F.coalesce(F.sum(F.when(good, F.col("bad_chars"))), F.lit(0)).alias("bad"),
        F.count_if(F.col("reason").isNotNull()).alias("filtered"), F.count("document_id").alias("passed"), F.count(F.when(good, given)).alias("with_count"),
    )
    rows = materialize(rows, "audit-rows")
    facts = seen.get
    kinds = {(r["error"], r["reason"]): r["n"] for r in rows.groupBy("error", "reason").agg(F.count("*").alias("n")).collect()}
    errors = {e: n for (e, _), n in sorted(kinds.items(), key=str) if e is not None}
    reasons = {r: n for (_, r), n in sorted(kinds.items(), key=lambda x: (-x[1], str(x[0]))) if r is not None}
    flags = [f"has_{k}" for k in ("hangul", "latin", "digits", "math")]
    firsts = dedup.places(rows.filter("document_id IS NOT NULL"), "hash", ["path", "ord"], ["document_id", "chars", "row", *flags])
    unique = materialize(firsts, "audit-unique")
    lengths = _row(unique.agg(*_spread_of("chars", 50, 90, 95, 99), F.count_if(F.col("chars") >= 10_000).alias("ge_10k"), F.count_if(F.col("chars") >= 50_000).alias("ge_50k"), *[F.count_if(F.col(k)).alias(k) for k in flags]))
    n_kept, chars, hangul = lengths["n"], lengths["total"], lengths["has_hangul"]
    duplicates = facts["passed"] - n_kept

    sample = unique if full else stats.bottom_sample(unique.select("document_id", "row"), "document_id", sample_documents, seed)
    texts = rows.select("row", "text", "chars", "prov").join(sample.select("row"), "row", "left_semi")
    ids = texts.withColumn("ids", tokens.encoder(spark, tok, eos)(F.col("text")))
    counted = materialize(ids.select("row", "chars", "prov", F.size("ids").alias("tokens"), (~tokens.valid_ids(F.col("ids"), tok.get_vocab_size())).alias("bad")), "audit-tokens")
    size = _row(counted.agg(*_spread_of("tokens", 50, 90, 95, 99), F.count_if("bad").alias("bad"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count(given).alias("given"), F.coalesce(F.sum(given), F.lit(0)).alias("given_total")))
    if size["bad"]:
        raise ValueError("the tokenizer gives ids outside its vocabulary")
    if full:
        content = max(0, size["total"] - size["n"])
        estimate = {"chars_per_token": chars / content if content else None, "estimated_total_tokens": size["total"], "estimated_token_range": [size["total"]] * 2, "method": "full_tokenization", "is_estimate": False}
    else:
        e = _row(stats.token_estimate(unique.select("chars"), counted))
        estimate = {"chars_per_token": e["chars_per_token"], "estimated_total_tokens": e["estimated"], "estimated_token_range": [e["low"], e["high"]], "method": "character_based_plus_eos", "is_estimate": True}
    compared = None
    if size["given"] and size["n"]:
        theirs, own = size["given_total"] / size["given"], size["total"] / size["n"]
        compared = {"sample_docs_with_token_count": size["given"], "dataset_token_count_total": size["given_total"], "dataset_tokens_per_document": theirs, "own_tokens_per_document": own, "ratio": own / theirs if theirs else None}
    disk, names = sum(r["length"] for r in listed), [r["path"].rpartition("/")[2] for r in listed]
    scale = _row(stats.scale_estimate(spark.createDataFrame([(int(estimate["estimated_total_tokens"]), disk, len(listed))], "tokens long, disk_bytes long, files int")))
    previews = []
    if preview_count:
        few = stats.bottom_sample(unique.select("document_id", "row"), "document_id", preview_count, seed).join(rows.select("row", "chars", tx.preview(F.col("text"), 120).alias("preview")), "row")
        held = few.join(counted.select("row", "tokens"), "row", "left").orderBy("document_id").collect()
        previews = [{"document_id": r["document_id"], "chars": r["chars"], "tokens": r["tokens"], "preview": r["preview"]} for r in held]

    raw_documents = facts["raw"]
    mean_chars = facts["raw_chars"] / raw_documents if raw_documents else 0.0
    points = {k: lengths[k] for k in ("p50", "p90", "p95", "p99")}
    filter_config = {k: getattr(config, k) for k in ("min_chars", "max_repeat_ratio", "min_alpha_hangul_ratio", "max_whitespace_ratio", "max_punct_ratio")}
    sha = sha256_file(tokenizer)
    report = {
        "source": source, "language": language, "pipeline_version": PIPELINE_VERSION, "unicode_normalization": "NFC", "timestamp_utc": datetime.now(UTC).isoformat(), "mode": "full" if full else "fast", "files": names, "disk_bytes": disk,
        "raw_documents": raw_documents, "kept_documents": n_kept, "filtered_documents": facts["filtered"], "duplicates_removed": duplicates, "raw_characters": facts["raw_chars"], "kept_characters": chars,
        "sample_documents": size["n"], "sample_characters": size["chars"], "sample_tokens": size["total"], "chars_per_token": estimate["chars_per_token"], "estimated_total_tokens": estimate["estimated_total_tokens"], "estimated_token_range": estimate["estimated_token_range"], "tokenizer_fingerprint": sha,
        "language_statistics": _languages(rows), "education_score_statistics": _education(rows, counted), "dataset_token_comparison": compared,
        "input": {"path": Path(path).as_posix() if "://" not in path else path, "format": fmt, "files": names, "file_count": len(names), "disk_bytes": disk, "disk_mb": disk / 1e6, "schema_columns": columns, "text_field": text_field, "raw_documents": raw_documents, "raw_characters": facts["raw_chars"], "average_chars_per_document": mean_chars, "parse_errors": errors, "has_token_count_field": "token_count" in columns},
        "cleaning": {"filter_config": filter_config | {"language_policy": language}, "filter_reasons": reasons, "filtered_documents": facts["filtered"], "duplicates_removed": duplicates, "kept_documents": n_kept, "kept_characters": chars, "keep_rate": n_kept / raw_documents if raw_documents else 0.0, "hangul_document_ratio": hangul / n_kept if n_kept else 0.0, "replacement_char_count_in_raw": facts["bad"]},
        "wikipedia_sanity": {"documents_containing_hangul": hangul, "documents_containing_latin": lengths["has_latin"], "documents_containing_digits": lengths["has_digits"], "documents_containing_math_like": lengths["has_math"], "note": "Counts only; not used for filtering."},
        "long_documents": {"character_median": points["p50"]} | {f"character_{k}": v for k, v in points.items()} | {"character_maximum": lengths["most"], "approx_docs_ge_10k_chars": lengths["ge_10k"], "approx_docs_ge_50k_chars": lengths["ge_50k"]} | {f"token_{k}_sample": size[k] for k in points} | {"token_maximum_sample": size["most"]},
        "token_sample": {"sample_documents": size["n"], "sample_characters": size["chars"], "sample_tokens": size["total"], "sample_seed": seed, "average_tokens_per_document": size["mean"], "median_tokens_per_document": size["p50"], "min_tokens_per_document": size["least"], "max_tokens_per_document": size["most"], "p90": size["p90"], "p95": size["p95"], "p99": size["p99"], "chars_per_token": estimate["chars_per_token"], "eos_included": True},
        "estimate": estimate, "tokenizer": {"path": Path(tokenizer).as_posix(), "sha256": sha, "vocab_size": tok.get_vocab_size(), "eos_token_id": eos, "invalid_token_ids": 0, "texts_encoded": size["n"]},
        "scale_estimate": scale, "samples": previews, "integrity": {"hangul_preserved_check": hangul > 0 if n_kept else True, "original_files_modified": False, "full_tokenization_performed": full, "elapsed_seconds": time.perf_counter() - began},
    }
    release(rows, unique, counted)
    report = LAYOUTS[layout](report)
    if output:
        write_json(Path(output), report)
    return report


def scale_layout(report: dict) -> dict:
    """The layout of a full audit that asks how far the tokens go: fields of the report under its names."""
    inp, clean, size, scale = report["input"], report["cleaning"], report["token_sample"], report["scale_estimate"]
    per = stats.TOKENS_PER_PARAMETER
    return {
        **{k: report[k] for k in ("source", "language", "pipeline_version", "unicode_normalization", "timestamp_utc")},
        "input": {k: inp[k] for k in ("path", "files", "file_count", "disk_bytes", "disk_mb", "schema_columns", "text_field", "raw_documents", "raw_characters", "average_chars_per_document")} | {"parse_errors": sum(inp["parse_errors"].values())},
        "cleaning": {"filter_config": {k: v for k, v in clean["filter_config"].items() if k != "language_policy"}} | {k: clean[k] for k in ("filter_reasons", "filtered_documents", "duplicates_removed", "kept_documents", "keep_rate", "hangul_document_ratio", "replacement_char_count_in_raw")},
        "tokenizer": {k: report["tokenizer"][k] for k in ("path", "sha256", "vocab_size", "eos_token_id")} | {"total_tokens": size["sample_tokens"], "eos_count": size["sample_documents"]} | {k: size[k] for k in ("average_tokens_per_document", "median_tokens_per_document", "min_tokens_per_document", "max_tokens_per_document", "p90", "p95", "p99")} | {"invalid_token_ids": 0},
        "scale_estimate": {
            "model_params": stats.MODEL_PARAMETERS, "rule_of_thumb": f"~{per} tokens/param (Chinchilla-style heuristic)", "estimated_tokens_needed": scale["needed"], "available_tokens": scale["tokens"], "coverage_vs_estimate": scale["coverage"], "tokens_missing_vs_estimate": scale["missing"],
            "tokens_per_mb_observed": scale["tokens_per_mb"], "additional_mb_estimate": scale["extra_mb"], "additional_shards_estimate": scale["extra_shards"], "note": f"estimated_tokens_needed is a heuristic (~{per} tok/param), not a guarantee of optimal training quality.",
        },
        "integrity": {k: report["integrity"][k] for k in ("hangul_preserved_check", "original_files_modified", "elapsed_seconds")},
        "samples": report["samples"],
    }


LAYOUTS = {"general": lambda report: report, "scale": scale_layout}


def _shown(value, form: str) -> str:
    """A number in a form; what is none as it is."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value
    return format(value, form) if number else str(value)


def _table(title: str, *lines: tuple) -> list[str]:
    """A heading and its lines: a name, a value, a form."""
    return [title, "-" * len(title), *[f"{name}: {_shown(value, form)}" for name, value, form in lines], ""]


def render(report: dict) -> str:
    """The report as tables for a console; reasons with the most documents first."""
    if "token_sample" not in report:
        return _render_scale(report)
    inp, clean, size, est, long_ = (report[k] for k in ("input", "cleaning", "token_sample", "estimate", "long_documents"))
    out = [f"{report['source']} ({report['mode']}): {report['raw_documents']:,} documents, {report['kept_documents']:,} kept", ""]
    out += _table("Input", ("Files", f"{inp['file_count']} ({', '.join(inp['files'])})", ""), ("Disk size (MB)", inp["disk_mb"], ".2f"), ("Raw documents", inp["raw_documents"], ","), ("Raw characters", inp["raw_characters"], ","))
    out += _table("Cleaning", ("Kept", clean["kept_documents"], ","), ("Filtered", clean["filtered_documents"], ","), ("Duplicates", clean["duplicates_removed"], ","), ("Keep rate", clean["keep_rate"], ".4f"))
    out += _table("Filter reasons", *[(k, n, ",") for k, n in sorted(clean["filter_reasons"].items(), key=lambda x: (-x[1], x[0]))])
    if lang := report["language_statistics"]:
        s = lang["language_score"]
        out += _table("Language", ("English ratio", lang["english_ratio"], ".4f"), ("Language score mean", s["mean"], ".6f"), ("Median", s["median"], ".6f"), ("P10", s["p10"], ".6f"), ("Minimum", s["minimum"], ""))
    if edu := report["education_score_statistics"]:
        out += _table("Education quality", *[(f"int_score {k}", f"{v['documents']:,} ({v['ratio']:.4f})", "") for k, v in edu["by_int_score"].items()], ("Score >= 4 ratio", edu["score_ge_4_ratio"], ".4f"), ("Score 5 ratio", edu["int_score_5_ratio"], ".4f"))
    out += _table("Token sample", ("Sample documents", size["sample_documents"], ","), ("Sample characters", size["sample_characters"], ","), ("Sample tokens", size["sample_tokens"], ","), ("Average tokens/document", size["average_tokens_per_document"], ".1f"), ("Median", size["median_tokens_per_document"], ".1f"), *[(k.upper(), size[k], ".1f") for k in ("p90", "p95", "p99")], ("Maximum", size["max_tokens_per_document"], ""), ("Chars/token", size["chars_per_token"], ".4f"))
    low, high = est["estimated_token_range"]
    out += _table("Estimate", ("Estimated total tokens" if est["is_estimate"] else "Total tokens (exact)", est["estimated_total_tokens"], ","), ("Estimated range", f"{low:,}-{high:,}", ""), ("Method", f"{est['method']} (is_estimate={est['is_estimate']})", ""))
    if both := report["dataset_token_comparison"]:
        out += _table("Dataset token comparison", ("Dataset token_count/sample", both["dataset_tokens_per_document"], ".2f"), ("Own token count/sample", both["own_tokens_per_document"], ".2f"), ("Ratio", both["ratio"], ".4f"))
    out += _table("Long documents", ("Character P95", long_["character_p95"], ".1f"), ("Character P99", long_["character_p99"], ".1f"), ("Character max", long_["character_maximum"], ""), ("Token P95", long_["token_p95_sample"], ".1f"), ("Token P99", long_["token_p99_sample"], ".1f"), ("Token max", long_["token_maximum_sample"], ""))
    whole = report["integrity"]
    out += _table("Integrity", ("Invalid token IDs", report["tokenizer"]["invalid_token_ids"], ""), ("Original files modified", whole["original_files_modified"], ""))
    out += _table("Performance", ("Elapsed (s)", whole["elapsed_seconds"], ".1f"), ("Full tokenization performed", whole["full_tokenization_performed"], ""))
    return "\n".join(out)


def _render_scale(report: dict) -> str:
    inp, clean, tok, scale, whole = (report[k] for k in ("input", "cleaning", "tokenizer", "scale_estimate", "integrity"))
    out = [f"{report['source']}: {inp['raw_documents']:,} documents, {clean['kept_documents']:,} kept", ""]
    out += _table("Input", ("Files", f"{inp['file_count']} ({', '.join(inp['files'])})", ""), ("Disk size (MB)", inp["disk_mb"], ".2f"), ("Raw documents", inp["raw_documents"], ","), ("Raw characters", inp["raw_characters"], ","), ("Average characters/document", inp["average_chars_per_document"], ".1f"))
    out += _table("Cleaning", ("Kept", clean["kept_documents"], ","), ("Filtered", clean["filtered_documents"], ","), ("Duplicates", clean["duplicates_removed"], ","), ("Keep rate", clean["keep_rate"], ".4f"), ("Filter reasons", clean["filter_reasons"], ""), ("Hangul doc ratio (kept)", clean["hangul_document_ratio"], ".4f"))
    out += _table("Tokenizer", ("Tokenizer", tok["path"], ""), ("Vocab size", tok["vocab_size"], ""), ("Total tokens", tok["total_tokens"], ","), ("Average tokens/document", tok["average_tokens_per_document"], ".1f"), ("Median tokens/document", tok["median_tokens_per_document"], ".1f"), ("Min/Max", f"{tok['min_tokens_per_document']} / {tok['max_tokens_per_document']}", ""), *[(k.upper(), tok[k], ".1f") for k in ("p90", "p95", "p99")])
    out += _table(
        "Scale estimate (heuristic)", ("Model params", scale["model_params"], ","), ("Rule of thumb", scale["rule_of_thumb"], ""), ("Estimated tokens needed", scale["estimated_tokens_needed"], ","), ("Available (this data after pipeline)", scale["available_tokens"], ","), ("Coverage vs estimate", scale["coverage_vs_estimate"], ".4f"),
        ("Missing vs estimate", scale["tokens_missing_vs_estimate"], ","), ("Tokens per MB (observed)", scale["tokens_per_mb_observed"], ".1f"), ("Additional MB (estimate)", scale["additional_mb_estimate"], ".1f"), ("Additional shards (estimate)", scale["additional_shards_estimate"], ".2f"), ("Note", scale["note"], ""),
    )
    out += _table("Integrity", ("Hangul preserved (any kept docs)", whole["hangul_preserved_check"], ""), ("Invalid token IDs", tok["invalid_token_ids"], ""), ("Original files modified", whole["original_files_modified"], ""), ("Elapsed (s)", whole["elapsed_seconds"], ".1f"))
    return "\n".join(out)
