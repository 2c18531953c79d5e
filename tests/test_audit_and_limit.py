"""The audit's two layouts against plain Python, the console's tables, and the first rows of files."""

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, limit, tokens
from millrace.plans import audit, build, cli, corpus_queries, report_queries

SAY = "Numbered text {} is made of quite ordinary words, and long enough to stay in the corpus."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("audit")
    rows = [(SAY.format(k) + " 한국어 1 ≤ 2" * (k % 3 == 0), "en" if k % 4 else "de", 0.9 - k / 100, str(k % 3 + 3), 20 + k) for k in range(20)]
    rows += [(SAY.format(1), "en", 0.5, None, None), ("short", "en", 0.4, "4", 1), (None, "en", None, "5", 2), ("broken �" + "!?" * 30, "en", 0.1, None, None), ("x" * 100, "en", 0.2, None, 7), (" \n", None, None, None, None)]
    table = spark.createDataFrame(rows, "text string, language string, language_score double, int_score string, token_count long").coalesce(1)
    table.write.parquet(str(root / "p"))
    tokens.train(table.select(F.coalesce("text", F.lit("")).alias("line")), str(root / "t.json"), vocab_size=300, min_frequency=1)
    return root, rows


def test_general_layout(spark, corpus):
    root, rows = corpus
    report = audit.audit(spark, str(root / "p"), "parquet", "p", str(root / "t.json"), str(root / "r.json"), "en", sample_documents=5, preview_count=2)
    texts = [r[0] for r in rows if r[0] is not None]
    kept = [SAY.format(k) + " 한국어 1 ≤ 2" * (k % 3 == 0) for k in range(20)]
    assert (report["raw_documents"], report["raw_characters"]) == (len(texts), sum(map(len, texts)))
    assert report["cleaning"]["filter_reasons"] == {"empty": 1, "excessive_punctuation": 1, "repetition": 1, "too_short": 1} and report["filtered_documents"] == 4
    assert (report["kept_documents"], report["duplicates_removed"], report["kept_characters"]) == (20, 1, sum(map(len, kept)))
    assert report["input"]["parse_errors"] == {"null_text": 1} and report["cleaning"]["replacement_char_count_in_raw"] == 1
    assert report["wikipedia_sanity"] | {"note": 0} == {"documents_containing_hangul": 7, "documents_containing_latin": 20, "documents_containing_digits": 20, "documents_containing_math_like": 7, "note": 0}
    lengths = sorted(map(len, kept))
    assert [report["long_documents"][f"character_p{p}"] for p in (50, 90, 95, 99)] == pytest.approx([np.percentile(lengths, p) for p in (50, 90, 95, 99)])
    lang = report["language_statistics"]
    assert lang["language_counts"] == {"de": 5, "en": 19} and lang["english_ratio"] == 19 / 24
    scores = [r[2] for r in rows if r[0] is not None and r[2] is not None]
    assert (lang["language_score"]["count"], lang["language_score"]["minimum"]) == (len(scores), min(scores))
    assert [lang["language_score"][k] for k in ("mean", "median")] == pytest.approx([statistics.mean(scores), statistics.median(scores)])
    edu = report["education_score_statistics"]
    by = {str(s): sum(r[3] == str(s) for r in rows if r[0] is not None) for s in (3, 4, 5)}
    assert {k: v["documents"] for k, v in edu["by_int_score"].items()} == by and edu["score_ge_4_documents"] == by["4"] + by["5"] and edu["int_score_5_ratio"] == by["5"] / sum(by.values())
    assert report["sample_documents"] == 5 == report["dataset_token_comparison"]["sample_docs_with_token_count"] and report["estimate"]["is_estimate"]
    assert [set(s) for s in report["samples"]] == [{"document_id", "chars", "tokens", "preview"}] * 2
    shown = audit.render(report)
    for title in ("Input", "Cleaning", "Filter reasons", "Language", "Education quality", "Token sample", "Estimate", "Dataset token comparison", "Long documents", "Integrity", "Performance"):
        assert f"\n{title}\n{'-' * len(title)}\n" in shown
    assert "Kept: 20\n" in shown and f"Raw characters: {sum(map(len, texts)):,}\n" in shown and "English ratio: 0.7917\n" in shown


def test_scale_layout(spark, corpus, capsys):
    root, rows = corpus
    tok = tokens.load(str(root / "t.json"))
    report = audit.audit(spark, str(root / "p"), "parquet", "p", str(root / "t.json"), str(root / "s.json"), "ko", layout="scale", preview_count=3)
    assert json.loads((root / "s.json").read_text()) == json.loads(json.dumps(report))
    assert list(report) == ["source", "language", "pipeline_version", "unicode_normalization", "timestamp_utc", "input", "cleaning", "tokenizer", "scale_estimate", "integrity", "samples"]
    sizes = [len(tok.encode(SAY.format(k) + " 한국어 1 ≤ 2" * (k % 3 == 0)).ids) + 1 for k in range(20)]
    own = report["tokenizer"]
    assert (own["total_tokens"], own["eos_count"], own["min_tokens_per_document"], own["max_tokens_per_document"]) == (sum(sizes), 20, min(sizes), max(sizes))
    assert own["p95"] == pytest.approx(np.percentile(sizes, 95)) and own["median_tokens_per_document"] == np.percentile(sizes, 50)
    scale = report["scale_estimate"]
    assert scale["available_tokens"] == sum(sizes) and scale["estimated_tokens_needed"] == 736_757_760 and scale["tokens_missing_vs_estimate"] == 736_757_760 - sum(sizes)
    assert scale["tokens_per_mb_observed"] == pytest.approx(sum(sizes) / report["input"]["disk_mb"]) and report["input"]["parse_errors"] == 1
    assert {s["tokens"] for s in report["samples"]} <= set(sizes)
    assert cli.main(["audit", "--input", str(root / "p"), "--source", "p", "--tokenizer", str(root / "t.json"), "--output", str(root / "c.json"), "--layout", "scale"]) == 0
    assert "Scale estimate (heuristic)\n--------------------------\nModel params: 36,837,888\n" in capsys.readouterr().out
    with pytest.raises(ValueError, match="layout"):
        audit.audit(spark, str(root / "p"), "parquet", "p", str(root / "t.json"), layout="other")


def test_an_audit_of_few_documents(spark, corpus):
    root, rows = corpus
    report = audit.audit(spark, str(root / "p"), "parquet", "p", str(root / "t.json"), None, "en", max_documents=4, full=True)
    assert (report["raw_documents"], report["kept_documents"], report["estimate"]["method"]) == (4, 4, "full_tokenization")
    none = audit.audit(spark, str(root / "p"), "parquet", "p", str(root / "t.json"), None, "en", max_documents=0)
    assert (none["raw_documents"], none["kept_documents"], none["estimated_total_tokens"], none["language_statistics"]) == (0, 0, 0, None)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 29, 30, 31, 100])
def test_first_rows_of_files(spark, n):
    rows = [(k % 2, f"f{k % 3}", k * 7 % 30, "text") for k in range(30)]
    docs = spark.createDataFrame(rows, "src int, path string, ord long, text string").repartition(4)
    got = limit.first(docs, n, ["src", "path"], "ord")
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows, key=lambda r: r[:3])[:n]
    assert "Exchange" not in got.drop("text")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_places_and_counts_without_texts(spark):
    docs = spark.createDataFrame([("b", 1, "h", 5), ("a", 2, "h", 5), ("a", 3, "g", 7), ("b", 4, "h", 5)], "source string, ord int, hash string, chars int")
    kept = dedup.places(docs, "hash", ["source", "ord"], ["chars"])
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 2, 5), ("a", 3, 7)]
    assert {r["source"]: tuple(r)[1:] for r in dedup.counts(docs, kept).collect()} == {"a": (2, 2, 0), "b": (2, 0, 2)}


def test_build_keeps_parts_and_limits_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(12):
        (tmp_path / "a" / f"{k:02d}.txt").write_text(SAY.format(k % 10))
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"name": "a", "path": "a", "format": "txt", "weight": 1}]}))
    tok = tokens.train(spark.createDataFrame([(SAY.format(k),) for k in range(10)], "line string"), str(tmp_path / "t.json"), vocab_size=120, min_frequency=1)
    asked = dict(tokenizer=str(tmp_path / "t.json"), validation_ratio=0.2, vocab_size=tok.get_vocab_size(), max_documents=11)  # noqa: C408
    one, parts = (build.build(spark, str(tmp_path / "m.json"), str(tmp_path / f"o{k}"), single_files=k == 0, **asked) for k in range(2))
    assert one["train_tokens"] == parts["train_tokens"] and one["unique_documents_after_dedup"] == 10
    assert json.loads((tmp_path / "o0/statistics.json").read_text())["duplicates_removed"] == 1
    from millrace.sources import token_bin

    stream = token_bin.read_bin(spark, str(tmp_path / "o1/train.bin")).orderBy("pos").toPandas()["token"]
    assert stream.tolist() == np.fromfile(tmp_path / "o0/train.bin", np.uint16).tolist()


@pytest.mark.parametrize("rows", [50, 5000])
def test_offsets_compute_their_rows_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.range(rows).mapInArrow(count, "id long")
    got = tokens.offsets(docs, "id", ["id"], block_rows=1000).orderBy("id").collect()
    assert [r["offset"] for r in got] == [k * (k - 1) // 2 for k in range(rows)]
    assert seen.value == rows


def test_source_report_reads_the_texts_once(spark, monkeypatch):
    reads = []
    plain = corpus_queries.table
    monkeypatch.setattr(corpus_queries, "table", lambda spark, d, name: reads.append(name) or plain(spark, d, name))
    assert report_queries.source_report(spark, "/root/testdata/sf0.001").count() > 1
    assert reads == ["documents"]
