import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import tokens
from millrace.plans import audit, build, cli
from millrace.sources import readers, token_bin
from millrace.streaming import corpus

GOOD = "This is a quite ordinary sentence, number {} of a small test corpus for the build."


@pytest.fixture
def corpus_dir(tmp_path, spark):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for k in range(8):
        (tmp_path / "a" / f"{k}.txt").write_text(GOOD.format(k))
    (tmp_path / "a" / "short.txt").write_text("short")
    (tmp_path / "a" / "broken.TXT").write_bytes(b"bytes \xff that are not UTF-8, in a text that is long enough to stay")
    lines = [json.dumps({"text": GOOD.format(k), "id": k}) for k in (1, 20, 21)]
    (tmp_path / "b" / "x.jsonl").write_text("\n".join([*lines, "", "{bad", "[1]", '{"content": "x"}', '{"text": 5}', '{"text": "a"} x']))
    spark.createDataFrame([(GOOD.format(k), "u", 3.5) for k in range(30, 34)] + [(None, "v", None)], "text string, url string, score double").write.parquet(str(tmp_path / "p"))
    manifest = {"sources": [
        {"name": "a", "path": "a", "format": "txt", "language": "en", "weight": 2},
        {"name": "b", "path": "b/x.jsonl", "format": "JSONL", "weight": 1},
        {"name": "p", "path": str(tmp_path / "p"), "format": "parquet", "weight": 1, "language": "en"},
        {"name": "none", "path": "b/x.jsonl", "format": "jsonl", "weight": 0, "text_field": "content"},
    ]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    return tmp_path


def test_readers(spark, corpus_dir):
    rows = readers.read_jsonl(spark, str(corpus_dir / "b"), "b")
    errors = sorted(r["error"] for r in rows.filter("error IS NOT NULL").collect())
    assert errors == ["malformed_json:x.jsonl:5", "malformed_json:x.jsonl:9", "missing_field:x.jsonl:7", "non_string_text:x.jsonl:8", "not_object:x.jsonl:6"]
    assert {r["line"]: r["prov"] for r in rows.filter("error IS NULL").collect()} == {1: {"id": "1"}, 2: {"id": "20"}, 3: {"id": "21"}}
    texts = [r["text"] for r in readers.read_txt(spark, str(corpus_dir / "a"), "a").collect()]
    assert len(texts) == 10 and any("�" in t for t in texts)
    found = readers.read_parquet(spark, str(corpus_dir / "p"), "p")
    assert found.filter("error LIKE 'null_text:%'").count() == 1
    assert found.filter("text IS NOT NULL").first()["prov"] == {"url": "u", "score": "3.5"}
    with pytest.raises(ValueError, match="body"):
        readers.read_parquet(spark, str(corpus_dir / "p"), "p", text_field="body")
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_source(spark, "x", "x", "csv")
    with pytest.raises(FileNotFoundError):
        readers.list_files(str(corpus_dir / "nothing"), ".txt")
    with pytest.raises(FileNotFoundError, match="no .txt"):
        readers.list_files(str(corpus_dir / "b"), ".txt")
    assert len(readers.read_lines(spark, str(corpus_dir / "a")).collect()) == 10


@pytest.mark.parametrize("bad", [{}, {"sources": []}, {"sources": [{"name": "x"}]}, {"sources": [{"name": "x", "path": "p", "format": "txt", "weight": -1}]}])
def test_manifests_are_validated(tmp_path, bad):
    (tmp_path / "m.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        readers.load_manifest(str(tmp_path / "m.json"))


def test_build_and_read_back(spark, corpus_dir):
    tok = tokens.train(readers.read_lines(spark, str(corpus_dir / "a")), str(corpus_dir / "t.json"), vocab_size=200, min_frequency=1)
    size = tok.get_vocab_size()
    assert [tok.token_to_id(s) for s in tokens.SPECIALS] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="entries"):
        tokens.validate(tok, size + 1)
    dry = build.build(spark, str(corpus_dir / "m.json"), str(corpus_dir / "dry"), dry_run=True, validation_ratio=0.25)
    assert dry["dedup"] == {"kept": 15, "duplicates": 1, "by_source": dry["dedup"]["by_source"]}
    assert dry["filter_reasons"] == {"too_short": 2}
    runs = [build.build(spark, str(corpus_dir / "m.json"), str(corpus_dir / f"out{k}"), str(corpus_dir / "t.json"), 0.25, vocab_size=size) for k in range(2)]
    assert runs[0]["fingerprint"] == runs[1]["fingerprint"]
    assert (corpus_dir / "out0/train.bin").read_bytes() == (corpus_dir / "out1/train.bin").read_bytes()
    stream = np.fromfile(corpus_dir / "out0/train.bin", np.uint16)
    assert len(stream) == runs[0]["train_tokens"] and (stream == 3).sum() == runs[0]["eos_count_train"]
    back = token_bin.read_bin(spark, str(corpus_dir / "out0/train.bin")).orderBy("pos").toPandas()
    assert back["token"].tolist() == stream.tolist()
    assert tokens.samples(back_df := token_bin.read_bin(spark, str(corpus_dir / "out0/train.bin")), 16).count() == (back_df.count() - 1) // 16
    sources = json.loads((corpus_dir / "out0/sources.json").read_text())
    assert [s["name"] for s in sources] == ["a", "b", "p", "none"] and sum(s["duplicates"] for s in sources) == 1
    decode = tokens.decoder(spark, tok)
    ids = tok.encode("This is a test").ids
    assert spark.createDataFrame([(ids,)], "i array<int>").select(decode("i")).first()[0] == "This is a test"
    with open(corpus_dir / "out0/train.bin", "ab") as f:
        f.write(b"xx")
    with pytest.raises(Exception, match="bytes"):
        token_bin.read_bin(spark, str(corpus_dir / "out0/train.bin")).count()


def test_ids_outside_the_vocabulary_are_errors(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [9])], "k int, ids array<int>")
    with pytest.raises(Exception, match="outside"):
        token_bin.write_bin(rows, str(tmp_path / "x.bin"), 5, ["k"])


def test_audits(spark, corpus_dir):
    tokens.train(readers.read_lines(spark, str(corpus_dir / "a")), str(corpus_dir / "t.json"), vocab_size=200, min_frequency=1)
    for full in (False, True):
        report = audit.audit(spark, str(corpus_dir / "p"), "parquet", "p", str(corpus_dir / "t.json"), str(corpus_dir / "r.json"), "en", sample_documents=3, full=full)
        assert (report["raw_documents"], report["kept_documents"], report["sample_documents"]) == (4, 4, 4 if full else 3)
        assert report["input"]["parse_errors"] == {"null_text": 1} and report["estimated_total_tokens"] > 0
    assert "4 documents" in audit.render(report) and json.loads((corpus_dir / "r.json").read_text())["mode"] == "full"


def test_plain_preprocess_and_cli(spark, corpus_dir, capsys):
    (corpus_dir / "a" / "broken.TXT").unlink()
    assert cli.main(["train-tokenizer", "--input", str(corpus_dir / "a"), "--output", str(corpus_dir / "t.json"), "--vocab-size", "150", "--min-frequency", "1"]) == 0
    meta = build.preprocess(spark, str(corpus_dir / "a"), str(corpus_dir / "t.json"), str(corpus_dir / "pre"), 0.25)
    assert (meta["num_train_documents"], meta["num_val_documents"]) == (7, 2)
    assert cli.main(["synthetic", "--output", str(corpus_dir / "syn"), "--train-tokens", "100", "--val-tokens", "10"]) == 0
    assert token_bin.read_bin(spark, str(corpus_dir / "syn/val.bin")).count() == 10
    capsys.readouterr()


def test_stream_of_documents(spark, tmp_path):
    rows = [("s", "en", GOOD.format(k % 3)) for k in range(6)] + [("s", "en", "short")]
    df = spark.createDataFrame(rows, "source string, language string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = corpus.funnel(corpus.read(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("funnel_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("funnel_out").count() == 3
    assert spark.table("funnel_out").select(F.count_distinct("document_id")).first()[0] == 3
