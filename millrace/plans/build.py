"""The manifest build: scan, normalize, filter, dedup, split, mix, encode, write, report."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import __version__
from millrace.functions import text as tx
from millrace.operators import dedup, limit, mix, quality, split, tokens
from millrace.operators.quality import FilterConfig
from millrace.sources import readers, token_bin
from millrace.sources.tables import materialize, release

PIPELINE_VERSION = f"millrace-{__version__}"


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def write_json(path: Path, value) -> None:
    """Indented, not escaped; what is no number becomes null."""

    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(value), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def by_key(df: DataFrame, key: str) -> dict:
    """A small aggregate as a dict: one row for each source or reason."""
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


PLACE = ["src_idx", "path", "ord"]


def ingest(docs: DataFrame, config: FilterConfig, max_documents: int | None = None) -> DataFrame:
    """Every row of the sources with its place, normalized and judged: reason and preview of what is rejected,
    identities, length and text of what is kept, error of what can't be read. ``max_documents`` counts
    documents in the order of the sources."""
    if max_documents is not None:
        inside = limit.cut_off(docs.filter("error IS NULL").select(*PLACE), max_documents, ["src_idx", "path"], "ord")
        docs = docs if inside is None else docs.filter(F.col("error").isNotNull() | inside)
    rows = quality.classify(docs, config)
    stays, text = F.col("error").isNull() & F.col("reason").isNull(), F.col("text")
    return rows.select(
        *PLACE, "source", "error", F.when(F.col("error").isNull(), F.col("reason")).alias("reason"), F.when(F.col("reason").isNotNull(), tx.preview(text)).alias("preview"),
        F.when(stays, tx.document_id(F.col("source"), text)).alias("document_id"), F.when(stays, tx.content_hash(text)).alias("hash"), F.when(stays, F.length(text).cast("long")).alias("chars"), F.when(stays, text).alias("text"),
    ).withColumn("row", F.monotonically_increasing_id())


def build(
    spark: SparkSession, manifest: str, output: str, tokenizer: str | None = None, validation_ratio: float = 0.01, seed: int = 42, vocab_size: int = 32_000, min_chars: int = 32,
    max_documents: int | None = None, max_oversample: int = 3, text_field: str = "text", dry_run: bool = False, filter_overrides: dict | None = None, single_files: bool = True,
) -> dict:
    """Builds a training corpus from a manifest; a dry run stops before tokenization.

    Texts are written down once, with their hashes; everything up to the encoding reads the columns beside them, and
    encoding reads the texts that stay. ``single_files``: one file for each stream; else folders of parts."""
    sources = readers.load_manifest(manifest)["sources"]
    config = FilterConfig.of({"min_chars": min_chars, **(filter_overrides or {})})
    out = Path(output)
    whole = materialize(ingest(readers.read_manifest(spark, manifest, text_field), config, max_documents), "build-texts")
    good, lean = whole.filter("error IS NULL"), whole.filter("document_id IS NOT NULL").select(*PLACE, "source", "document_id", "hash", "chars", "row")
    unique = dedup.places(lean, "hash", ["source", "document_id", *PLACE], ["chars", "row"])
    both = materialize(split.split(materialize(unique, "build-unique"), validation_ratio, seed), "build-split")
    if split.overlap(both).limit(1).count():
        raise RuntimeError("a document is on both sides of the split")
    weights = spark.createDataFrame([(s["name"], float(s["weight"])) for s in sources], "source string, weight double")
    train = both.filter("split = 'train'").select("source", "document_id", "ord", "chars", "row")
    mixed = mix.mix(train, weights, max_oversample)
    mixed_stats = by_key(mix.stats(train, weights, mixed), "source")

    broken = whole.filter("error IS NOT NULL").groupBy("source", tx.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n")).collect()
    error_counts: dict[str, int] = {}
    error_sources: dict[str, int] = {}
    for r in broken:
        error_counts[r["kind"]] = error_counts.get(r["kind"], 0) + r["n"]
        error_sources[r["source"]] = error_sources.get(r["source"], 0) + r["n"]
    judged = good.groupBy("source", "reason").agg(F.count("*").alias("n")).collect()  # a row for each reason of each source
    none = {"input": 0, "kept_after_filter": 0, "filtered": 0}
    funnel = {s["name"]: none | {"parse_errors": error_sources.get(s["name"], 0)} for s in sources}
    found: dict[str, int] = {}
    for r in judged:
        own = funnel[r["source"]]
        own["input"] += r["n"]
        own["kept_after_filter" if r["reason"] is None else "filtered"] += r["n"]
        if r["reason"] is not None:
            found[r["reason"]] = found.get(r["reason"], 0) + r["n"]
    reasons = dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))
    samples: dict[str, list[str]] = {}
    for r in quality.first_previews(good.filter("preview <> ''"), PLACE).orderBy("reason", "nth").collect():
        samples.setdefault(r["reason"], []).append(r["preview"][:120])
    dedup_stats = by_key(dedup.counts(lean, both), "source")
    kept_docs, duplicates = (sum(s[k] for s in dedup_stats.values()) for k in ("kept", "duplicates"))
    sides = {r["split"]: r for r in both.groupBy("split").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    counts = {k: r["n"] for k, r in sides.items()}
    avg_chars = sum(r["chars"] for r in sides.values()) / sum(counts.values()) if counts else 0.0
    total_input = sum(f["input"] for f in funnel.values())
    totals = {"input_documents": total_input, "kept_after_filter": sum(f["kept_after_filter"] for f in funnel.values()), "filtered_documents": sum(f["filtered"] for f in funnel.values()), "filter_reasons": reasons, "filter_samples": samples, "parse_errors": error_counts}

    if dry_run:
        result = {"dry_run": True, "pipeline_version": PIPELINE_VERSION, "ingest": totals | {"by_source": funnel}, "dedup": {"kept": kept_docs, "duplicates": duplicates, "by_source": dedup_stats}, "split": {"train_documents": counts.get("train", 0), "val_documents": counts.get("val", 0)}, "mix": mixed_stats, "avg_chars_kept": avg_chars, "filter_reasons": reasons}
        write_json(out / "statistics.json", result)
        release(whole, both)
        return result

    if tokenizer is None:
        raise ValueError("a tokenizer is needed unless it is a dry run")
    tok = tokens.load(tokenizer)
    eos = tokens.validate(tok, vocab_size)
    out.mkdir(parents=True, exist_ok=True)
    encode = tokens.encoder(spark, tok, eos)
    texts = whole.select("row", "text").join(both.select("row", "source", "document_id", "ord", "split"), "row")
    encoded = materialize(texts.select("row", "source", "document_id", "ord", "split", encode(F.col("text")).alias("ids")), "build-ids")  # each text once, however often it is mixed
    stream = mixed.select("row", "source", "document_id", "ord", "pass").join(encoded.select("row", "ids"), "row")
    write = token_bin.write_bin if single_files else token_bin.write_stream
    train_tokens, train_docs = write(stream, str(out / "train.bin"), vocab_size, ["source", "pass", "document_id", "ord"])
    val_stream = encoded.filter("split = 'val'")
    val_tokens, val_docs = write(val_stream, str(out / "val.bin"), vocab_size, ["source", "document_id", "ord"])
    sizes = materialize(encoded.select("row", "source", "split", F.size("ids").alias("n")), "build-sizes")
    per = lambda df: by_key(df.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "source")
    train_by, val_by = per(mixed.select("row", "source").join(sizes.select("row", "n"), "row")), per(sizes.filter("split = 'val'"))

    weight_sum = sum(float(s["weight"]) for s in sources)
    nothing = {"tokens": 0, "docs": 0}
    listed = []
    for s in sources:
        name = s["name"]
        t, v = train_by.get(name, nothing), val_by.get(name, nothing)
        listed.append({k: s.get(k) for k in ("name", "path", "format", "language", "license", "url", "notes")} | {
            "weight": float(s["weight"]), "target_weight": float(s["weight"]) / weight_sum, "actual_train_token_ratio": t["tokens"] / train_tokens if train_tokens else 0.0,
            "input_docs": funnel[name]["input"], "kept_after_filter": funnel[name]["kept_after_filter"], "filtered": funnel[name]["filtered"], "duplicates": dedup_stats.get(name, {}).get("duplicates", 0),
            "train_docs_in_stream": t["docs"], "val_docs": v["docs"], "train_tokens": t["tokens"], "val_tokens": v["tokens"], "mix": mixed_stats.get(name, {}),
        })
    average = (train_tokens + val_tokens) / max(train_docs + val_docs, 1)
    tok_sha, man_sha = sha256_file(tokenizer), sha256_file(manifest)
    metadata = {
        "tokenizer": Path(tokenizer).as_posix(), "tokenizer_sha256": tok_sha, "manifest": Path(manifest).as_posix(), "manifest_sha256": man_sha, "vocab_size": vocab_size, "dtype": token_bin.choose_dtype(vocab_size),
        "train_tokens": train_tokens, "val_tokens": val_tokens, "train_documents": train_docs, "val_documents": val_docs, "unique_documents_after_dedup": kept_docs, "eos_token_id": eos, "eos_count_train": train_docs, "eos_count_val": val_docs,
        "validation_ratio": validation_ratio, "seed": seed, "pipeline_version": PIPELINE_VERSION, "train_bin": "train.bin", "val_bin": "val.bin" if val_docs else None, "num_train_documents": train_docs, "num_val_documents": val_docs,
        "average_tokens_per_document": average, "fingerprint": hashlib.sha256(f"{tok_sha}:{man_sha}:{PIPELINE_VERSION}:{seed}:{validation_ratio}".encode()).hexdigest(), "min_chars": min_chars, "max_oversample": max_oversample,
        "mixing": "char_proxy_target_token_budget", "unicode_normalization": "NFC",
    }
    statistics = {"pipeline_version": PIPELINE_VERSION} | totals | {"duplicates_removed": duplicates, "documents_after_dedup": kept_docs, "train_documents": train_docs, "val_documents": val_docs, "train_tokens": train_tokens, "val_tokens": val_tokens, "average_tokens_per_document": average, "eos_count": train_docs + val_docs, "sources": listed, "mix": mixed_stats}
    write_json(out / "metadata.json", metadata)
    write_json(out / "sources.json", listed)
    write_json(out / "statistics.json", statistics)
    write_json(out / "build_config.json", {"validation_ratio": validation_ratio, "seed": seed, "min_chars": min_chars, "dedup": True, "pipeline_version": PIPELINE_VERSION, "max_oversample": max_oversample, "vocab_size": vocab_size})
    release(whole, both, encoded, sizes)
    return metadata


def preprocess(spark: SparkSession, path: str, tokenizer: str, output: str, validation_ratio: float = 0.01, seed: int = 42) -> dict:
    """The plain path: text files, a seeded split of the file list, no cleaning."""
    import random

    files = readers.list_files(path, ".txt", spark)
    order = list(files)
    random.Random(seed).shuffle(order)
    n_val = 0 if len(order) == 1 or validation_ratio == 0 else min(max(1, round(len(order) * validation_ratio)), len(order) - 1)
    tok = tokens.load(tokenizer)
    eos, vocab_size, out = tok.token_to_id("<|eos|>"), tok.get_vocab_size(), Path(output)
    out.mkdir(parents=True, exist_ok=True)
    texts = readers.read_txt_strict(spark, path)
    encode = tokens.encoder(spark, tok, eos)
    counts = {}
    for name, own in (("val", order[:n_val]), ("train", order[n_val:])):
        target = out / f"{name}.bin"
        if not own:
            target.unlink(missing_ok=True)
            counts[name] = (0, 0)
            continue
        places = spark.createDataFrame([(Path(f).absolute().as_posix(), k) for k, f in enumerate(own)], "file string, k int")
        rows = texts.withColumn("file", F.regexp_replace("path", "^file:/+", "/")).join(F.broadcast(places), "file")
        counts[name] = token_bin.write_bin(rows.select("k", encode(F.col("text")).alias("ids")), str(target), vocab_size, ["k"])
    metadata = {"tokenizer": Path(tokenizer).as_posix(), "vocab_size": vocab_size, "dtype": token_bin.choose_dtype(vocab_size), "train_tokens": counts["train"][0], "val_tokens": counts["val"][0], "eos_token_id": eos, "validation_ratio": validation_ratio, "seed": seed, "num_train_documents": counts["train"][1], "num_val_documents": counts["val"][1], "train_bin": "train.bin", "val_bin": "val.bin" if n_val else None}
    write_json(out / "metadata.json", metadata)
    return metadata
