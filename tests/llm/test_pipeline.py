"""The pipeline: each stage on odd rows, and the whole run against a brute-force chain."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F
from test_llm_operators import best_fit, brute_hits, groups, sentences, shingle_sets

from millrace.llm import language_id, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(8)
    kinds = {"aa": "abcdeé", "bb": "mnopqü"}
    rows = []
    for k in range(90):
        lang = ("aa", "bb")[k % 2]
        body = "\n".join(sentences(r, kinds[lang], r.randrange(2, 14)) for _ in range(r.randrange(1, 6)))
        rows.append([k, body, lang if k % 3 else None, f"s{k % 4}", len(body)])
    item = rows[3][1].replace("\n", " ") + " " + rows[5][1].replace("\n", " ")
    rows += [[100 + k, f"{rows[k][1]} abab", "aa", "copies", 9] for k in range(0, 30, 2)]  # one line changed
    rows += [[200 + k, rows[k][1].replace(" ", "  "), "bb", "copies", 9] for k in range(1, 30, 2)]  # lines repeat whole
    rows += [[300, sentences(r, "abcde", 20) + " " + item + " " + sentences(r, "abcde", 20), "aa", "leak", 9]]
    rows += [[400, None, None, None, None], [401, "", "aa", "x", 0], [402, "12 34 ...", "aa", "x", 9], [403, "ab\n\n ab\nab", "aa", "x", 9]]
    rows += [[None, "abe cad deb cab acde bade", "aa", "x", 9], [404, "mno pqo onm", "bb", "x", 9], [404, "mno pqo onm", "bb", "y", 8], [404, "another text abc of the same id", "aa", "y", 8]]
    return rows, [[0, item], [1, "qm nq pm"], [2, None]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = documents()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def score(net, text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not any(map(str.isalpha, text or "")):
        return None
    x, _ = language_id.windows_of(raw, np.array([0, len(raw)]))
    p = net.log_probs(x)
    return float(np.exp(p)[:, p.sum(0).argmax()].mean())


def test_run_equals_a_brute_force_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = language_id.train(docs.filter(~language_id.held_out()))
    floor = language_id.least_score(docs, net)
    rows = [(r[0], r[1]) for r in documents()[0]]
    scored = [(d, t, score(net, t)) for d, t in rows]
    rows = [(d, t) for d, t, s in scored if s is not None and s >= floor]
    assert all(s is None or abs(s - floor) > 1e-4 for _, _, s in scored) and 0.5 < floor < 1

    # lines, in the order of ids (null first) and then of the texts' hashes
    fp = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").withColumn("h", F.xxhash64("text")).collect()}
    seen, out = [], {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, fp[x[1]])):
        keep, lost = [], False
        for raw in t.split("\n"):
            line = line_dedup.normal(raw)
            if re.search("[0-9a-z]|[^\x00-\x7f]", line):
                near = len(line.split(" ")) >= 5 or len(line) >= 25
                gone = any(line == s or near and n and line_dedup.within_one(line, s) for s, n in seen)
                seen.append((line, near))
                if gone:
                    lost = True
                    continue
            keep.append(raw)
        text = "\n".join(keep)
        if not lost or re.search("[0-9A-Za-z]|[^\x00-\x7f]", text):
            out[d, t] = text
    rows = [(d, out[d, t]) for d, t in rows if (d, t) in out]

    # one document of each group; rows without id stay; here equal ids are equal or far texts
    own = {k: t for k, (d, t) in enumerate(sorted(set(r for r in rows if r[0] is not None)))}
    ids = {k: d for k, (d, t) in enumerate(sorted(set(r for r in rows if r[0] is not None)))}
    rows = [(ids[k], own[k]) for k, (_, first) in groups(shingle_sets(own)).items() if first == k] + [r for r in rows if r[0] is None]

    items = {i: t for i, t in documents()[1] if t}
    rows = [(d, t) for d, t in rows if not brute_hits(t, items)]

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = []
    for d, t in rows:
        own = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, p, b, len(own[b : b + 2048]), zlib.crc32(np.array(own[b : b + 2048], "<u4").tobytes())) for p, b in enumerate(range(0, len(own), 2048))]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((x["id"] if "id" in x else x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got), key=str) == sorted(want, key=str)
    assert len({x["sequence_id"] for x in got}) == best_fit([w[3] for w in want], 2048)[0]
    left = {d for d, _ in rows}
    assert 300 not in left and not left & {400, 401, 402} and not left & set(range(201, 230)) and None in left and 40 <= len(left) < 130


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = ["score", "lang_pred", "hits", "id", "t", "h", "fp", "gone", "new", "i", "f", "k0", "cls", "turn", "length", "offset", "c0_", "__nth"]
    odd = docs.withColumns({c: F.lit(7) for c in clash} | {"held_out": F.lit(None).cast("boolean")})
    for rows in (odd, docs.limit(0), docs.withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})):
        got = stage(spark, rows, folder)
        if name != "best_fit_packing":
            assert got.columns == rows.columns
            assert got.dtypes == rows.dtypes
        n = got.count()
        assert n <= rows.count() if name != "best_fit_packing" else n >= rows.count()
    assert stage(spark, odd, folder).count() == stage(spark, docs, folder).count()


def test_the_whole_held_out_fold_sets_the_least_score(spark, monkeypatch):
    """Scores of few documents are low; only all of them tell how many."""
    def fake(docs, net, id, text, keep):
        judged.append(docs.count())
        return docs.select(id, *keep, F.col(keep[0]).alias("lang_pred"), F.col(text).cast("double").alias("score"))

    judged = []
    monkeypatch.setattr(language_id, "predict", fake)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("aa").alias("lang"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000).cast("string").alias("text"))
    scores = sorted(float(r["text"]) for r in docs.filter(language_id.held_out()).collect())
    got = language_id.least_score(docs, language_id.ByteNet(["aa", "bb"]))
    assert judged == [len(scores)] and len(scores) > 3000
    low = int(scores[int(0.005 * (len(scores) - 1))] * language_id.SCORE_STEPS) / language_id.SCORE_STEPS
    assert abs(got - (0.5 + low) / 2) < 1e-12
