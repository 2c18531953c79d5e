"""Command lines: ``python -m millrace.plans.cli build|audit|preprocess|train-tokenizer|synthetic ...``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="a training corpus from a manifest")
    b.add_argument("--manifest", required=True)
    b.add_argument("--tokenizer")
    b.add_argument("--output", required=True)
    b.add_argument("--validation-ratio", type=float, default=0.01)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--vocab-size", type=int, default=32_000)
    b.add_argument("--min-chars", type=int, default=32)
    b.add_argument("--max-documents", type=int)
    b.add_argument("--max-oversample", type=int, default=3)
    b.add_argument("--text-field", default="text")
    b.add_argument("--dry-run", action="store_true")
    b.add_argument("--parts", action="store_true", help="streams as folders of parts")
    a = sub.add_parser("audit", help="a report on one source")
    a.add_argument("--input", required=True)
    a.add_argument("--format", default="parquet")
    a.add_argument("--source", required=True)
    a.add_argument("--language")
    a.add_argument("--tokenizer", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--text-field", default="text")
    a.add_argument("--min-chars", type=int, default=32)
    a.add_argument("--sample-documents", type=int, default=10_000)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--max-documents", type=int)
    a.add_argument("--previews", type=int, default=0)
    a.add_argument("--full-token-audit", action="store_true")
    a.add_argument("--layout", choices=("general", "scale"), default="general")
    r = sub.add_parser("preprocess", help="text files to token streams, as they are")
    r.add_argument("--input", required=True)
    r.add_argument("--tokenizer", required=True)
    r.add_argument("--output-dir", required=True)
    r.add_argument("--validation-ratio", type=float, default=0.01)
    r.add_argument("--seed", type=int, default=42)
    t = sub.add_parser("train-tokenizer", help="a BPE tokenizer from text files")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--vocab-size", type=int, default=32_000)
    t.add_argument("--min-frequency", type=int, default=2)
    s = sub.add_parser("synthetic", help="token streams for smoke tests")
    s.add_argument("--output", required=True)
    s.add_argument("--vocab-size", type=int, default=128)
    s.add_argument("--train-tokens", type=int, default=4096)
    s.add_argument("--val-tokens", type=int, default=1024)
    s.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None) -> int:
    from millrace.operators import tokens
    from millrace.plans import audit, build
    from millrace.sources import readers, token_bin

    a = parser().parse_args(argv)
    spark = session()
    if a.command == "build":
        done = build.build(spark, a.manifest, a.output, a.tokenizer, a.validation_ratio, a.seed, a.vocab_size, a.min_chars, a.max_documents, a.max_oversample, a.text_field, a.dry_run, single_files=not a.parts)
    elif a.command == "audit":
        done = audit.audit(spark, a.input, a.format, a.source, a.tokenizer, a.output, a.language, a.text_field, a.min_chars, a.sample_documents, a.seed, a.full_token_audit, a.max_documents, a.previews, a.layout)
        print(audit.render(done))
        return 0
    elif a.command == "preprocess":
        done = build.preprocess(spark, a.input, a.tokenizer, a.output_dir, a.validation_ratio, a.seed)
    elif a.command == "train-tokenizer":
        tok = tokens.train(readers.read_lines(spark, a.input), a.output, a.vocab_size, a.min_frequency)
        done = {"vocab_size": tok.get_vocab_size(), "output": a.output}
    else:
        done = token_bin.synthetic_bins(spark, a.output, a.vocab_size, a.train_tokens, a.val_tokens, a.seed)
    print(json.dumps(done, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
