import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import dedup, mix, quality, split, stats, tokens
from millrace.operators.quality import FilterConfig
from millrace.sources import token_bin


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, t {kind}")
    return [r[1] for r in sorted(rows.select("k", f(F.col("t")).alias("x")).collect())]


def python_normal(t):
    t = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", t))
    t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t)
    t = "\n".join(x.rstrip() for x in t.split("\n"))
    return re.sub("\n{3,}", "\n\n", t).strip()


def test_normalize_literals(spark):
    given = ["hello  \r\nworld\t  \r\n", "a\n\n\n\n\nb", "a\x00b\nc\td\x07e", "é", "  \n", "A B"]
    assert column(spark, given, tx.normalize) == ["hello\nworld", "a\n\nb", "ab\nc\tde", "é", "", "A B"]


def test_normalize_matches_python_on_random_dirt(spark):
    r = random.Random(5)
    bits = ["a", "é", "é", "\r", "\n", "\r\n", " ", "\t", "\xa0", " ", " ", "\x00", "\x07", "\x85", "﻿", "​", "한", "ᄒ", "ᅡ", "😀", "\x1c"]
    given = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(500)]
    assert column(spark, given, tx.normalize) == [python_normal(t) for t in given]


def test_ratios_and_runs(spark):
    assert column(spark, ["", "aaab", "😀😀b", "ab"], tx.run_ratio) == [1.0, 0.75, 2 / 3, 0.5]
    assert column(spark, ["a_é!", "½x"], lambda t: tx.ratio(t, tx.PUNCTUATION)) == [0.25, 0.0]
    assert column(spark, [" EN ", "english", "en-GB", "eng", None, ""], tx.is_english) == [True, True, True, False, False, False]


@pytest.mark.parametrize(
    ("text", "language", "config", "reason"),
    [
        ("short", "en", {}, "too_short"),
        ("   \n", "en", {"min_chars": 1}, "empty"),
        ("ㅋ" * 80, "ko", {"min_chars": 10}, "repetition"),
        ("!?.," * 20, "en", {"enable_repetition": False, "max_punct_ratio": 0.3}, "excessive_punctuation"),
        ("12 34 " * 10, "en", {"min_chars": 10, "enable_repetition": False, "enable_punct": False}, "low_alpha"),
        ("12 34 " * 10, None, {"min_chars": 10, "enable_repetition": False, "enable_punct": False}, "low_alpha_hangul"),
        ("a b c d e f " * 5, "en", {"max_whitespace_ratio": 0.4}, "excessive_whitespace"),
        ("word " * 20, "en", {"max_chars": 50}, "too_long"),
        ("A plain sentence of quite ordinary length.", "de", {"unknown": 1}, None),
    ],
)
def test_reasons(spark, text, language, config, reason):
    rows = spark.createDataFrame([(text, language)], "text string, language string")
    assert quality.classify(rows, FilterConfig.of(config)).first()["reason"] == reason


def test_previews_and_counts(spark):
    rows = spark.createDataFrame([(k, f"t{k}", "x" if k % 2 else "y") for k in range(10)] + [(99, "", "x")], "ord int, text string, reason string")
    assert {r["reason"]: r["n"] for r in quality.reason_counts(rows).collect()} == {"x": 6, "y": 5}
    assert sorted((r["reason"], r["nth"], r["preview"]) for r in quality.previews(rows, ["ord"]).collect())[:3] == [("x", 1, "t1"), ("x", 2, "t3"), ("x", 3, "t5")]


def test_dedup_prefers_the_lesser_source(spark):
    rows = spark.createDataFrame([(1, "z", "i1", "same"), (2, "a", "i2", "same"), (3, "z", "i3", "other")], "k int, source string, document_id string, text string")
    won = dedup.winners(rows, "k", ["source", "document_id"])
    assert sorted(r["k"] for r in won.collect()) == [2, 3]
    ranked = dedup.ranked(rows, ["source", "document_id"])
    assert {r["source"]: (r["seen"], r["kept"], r["duplicates"]) for r in dedup.totals(ranked).collect()} == {"z": (2, 1, 1), "a": (1, 1, 0), None: (3, 2, 1)}


def test_split_moves_one_where_a_side_is_empty(spark):
    rows = spark.createDataFrame([("s", f"{k:064x}") for k in range(3)], "source string, document_id string")
    for ratio, sides in ((0.0001, {"val": 1, "train": 2}), (0.0, {"train": 3})):
        got = split.split(rows, ratio).groupBy("split").count()
        assert {r["split"]: r["count"] for r in got.collect()} == sides
    with pytest.raises(ValueError, match="ratio"):
        split.split(rows, 1.0)


def greedy(pool, target, most):
    out, total = [], 0
    for p in range(max(most, 1)):
        for k, c in enumerate(pool):
            if not (total < target or (p == 0 and k == 0)):
                return out
            out.append((p, k))
            total += c
    return out


def test_mix_is_the_greedy_fill_at_any_block_size(spark):
    r = random.Random(2)
    pools = {f"s{k}": [r.randrange(1, 90) for _ in range(r.randrange(1, 40))] for k in range(6)}
    ids = {s: sorted(f"{r.randrange(1 << 32):08x}{k:056x}" for k in range(len(p))) for s, p in pools.items()}
    docs = spark.createDataFrame([(s, i, 0, c) for s, p in pools.items() for i, c in zip(ids[s], p, strict=True)], "source string, document_id string, ord int, chars long")
    w = {"s0": 5.0, "s1": 0.0, "s2": 1.0, "s3": 9.0, "s4": 0.1, "gone": 2.0}
    weights = spark.createDataFrame(list(w.items()), "source string, weight double")
    total = sum(map(sum, pools.values()))
    want = {(s, p, ids[s][k]) for s in pools if s in w for p, k in greedy(pools[s], w[s] / sum(w.values()) * total, 3)}
    assert {(x["source"], x["pass"], x["document_id"]) for x in mix.mix(docs, weights, 3).collect()} == want
    cut = {(x["source"], x["document_id"]): (x["n"], x["before"]) for x in mix.prefixed(docs, block_rows=10).collect()}
    assert cut == {(s, i): (k + 1, sum(pools[s][:k])) for s in pools for k, i in enumerate(ids[s])}
    with pytest.raises(Exception, match="weights"):
        mix.normalized_weights(weights.withColumn("weight", F.lit(0.0))).collect()


def test_token_estimate_arithmetic(spark):
    kept = spark.createDataFrame([(50,)] * 20, "chars long")
    sample = spark.createDataFrame([(10, 5)] * 10, "chars long, tokens long")  # 100 chars, 40 content tokens
    row = stats.token_estimate(kept, sample).first()
    assert (row["chars_per_token"], row["estimated"]) == (2.5, 420)
    assert row["low"] <= 420 <= row["high"]
    none = stats.token_estimate(kept, sample.limit(0)).first()
    assert (none["estimated"], none["low"], none["high"]) == (0, 0, 0)


def test_samples_and_offsets(spark):
    for n, want in ((10, 2), (6, 1), (3, 0)):
        rows = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("token"))
        got = tokens.samples(rows, 4).orderBy("sample_id").collect()
        assert len(got) == want
        for k, s in enumerate(got):
            assert s["input_ids"] == [10 * x for x in range(4 * k, 4 * k + 4)]
            assert s["labels"] == [10 * x for x in range(4 * k + 1, 4 * k + 5)]
    docs = spark.createDataFrame([(k, k % 7) for k in range(100)], "k int, n long")
    for block in (1000, 9):
        assert {r["k"]: r["offset"] for r in tokens.offsets(docs, "n", ["k"], block).collect()} == {k: sum(x % 7 for x in range(k)) for k in range(100)}
    assert token_bin.choose_dtype(65_535) == "uint16" and token_bin.choose_dtype(65_536) == "uint32"


def test_funnel_normalizes_once(spark):
    """The normal form is not inlined into each branch, nor pushed below itself by the filter."""
    docs = spark.createDataFrame([("a", "en")], "text string, language string")
    plan = quality.kept(quality.classify(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_short_cuts_equal_the_patterns(spark):
    """Ends, line ends, newlines and counts, by their patterns over every text."""
    r = random.Random(5)
    odd = [*tx.SPACES, "\r", "\x00", "\x0b", "\x85", "\u200b", "\ufeff", "a", "Z", "_", "9", "é", "가", "ᄀ", "!", "$", "٣", "😀", "\n", "\n", " "]
    rows = spark.createDataFrame([("".join(r.choice(odd) for _ in range(r.randrange(0, 12))),) for _ in range(3000)] + [(None,)], "t string")
    t = F.col("t")
    by_pattern = lambda pattern, by="": F.regexp_replace(t, F.lit(pattern), F.lit(by))
    pairs = [
        (tx.strip(t), by_pattern(rf"\A{tx.SPACE}+|{tx.SPACE}+\z")),
        (tx.trim_line_ends(t), by_pattern(f"[{tx.WS}]+\n", "\n")),
        (tx.unify_newlines(t), by_pattern(r"\r\n?", "\n")),
        (tx.collapse_newlines(t), by_pattern("\n{3,}", "\n\n")),
        *[(tx.occurrences(t, p), F.length(t) - F.length(by_pattern(p))) for p in (tx.SPACE, tx.PUNCTUATION, tx.LATIN, tx.HANGUL_LATIN, r"\x{FFFD}")],
    ]
    for got, want in pairs:
        assert rows.filter(~got.eqNullSafe(want)).count() == 0
