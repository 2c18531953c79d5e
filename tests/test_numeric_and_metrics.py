"""The assembled model operators against numpy, configuration rules, tokenizer training, metric sinks."""

import json

import numpy as np
import tokenizers
from pyspark.sql import functions as F

from millrace.functions import numeric as nm
from millrace.operators import tokens as tk
from millrace.sources import metrics

D, H, FF, V, S = 8, 2, 6, 11, 5


def norm(x):
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6)


def rotated(x):
    n = x.shape[-1]
    angle = np.arange(x.shape[0])[:, None] * 10_000.0 ** (-2 * np.arange(n // 2) / n)
    out = np.empty_like(x)
    out[:, 0::2] = x[:, 0::2] * np.cos(angle) - x[:, 1::2] * np.sin(angle)
    out[:, 1::2] = x[:, 0::2] * np.sin(angle) + x[:, 1::2] * np.cos(angle)
    return out


def layer(x, w):
    n, out = norm(x), []
    q, k, v = (n @ w[s].T for s in ("wq", "wk", "wv"))
    for h in range(H):
        cut = slice(h * D // H, (h + 1) * D // H)
        s = rotated(q[:, cut]) @ rotated(k[:, cut]).T / np.sqrt(D // H)
        e = np.exp(np.where(np.tril(np.ones_like(s)) > 0, s, -np.inf))
        out.append(e / e.sum(1, keepdims=True) @ v[:, cut])
    x = x + np.concatenate(out, 1) @ w["wo"].T
    n = norm(x)
    g = n @ w["gate"].T
    return x + (g / (1 + np.exp(-g)) * (n @ w["up"].T)) @ w["down"].T


def test_forward_equals_numpy(spark):
    r = np.random.default_rng(4)
    shapes = {"wq": (D, D), "wk": (D, D), "wv": (D, D), "wo": (D, D), "gate": (FF, D), "up": (FF, D), "down": (D, FF)}
    layers = [{k: r.normal(size=s) for k, s in shapes.items()} for _ in range(2)]
    table, ids = r.normal(size=(V, D)), r.integers(0, V, (3, S))
    rows = spark.createDataFrame([(int(b), int(p), int(ids[b, p])) for b in range(3) for p in range(S)], "seq long, pos long, token long")
    known = spark.createDataFrame([(t, x.tolist()) for t, x in enumerate(table)], "token long, x array<double>")
    kinds = ", ".join(f"{k} array<array<double>>" for k in shapes)
    weights = [spark.createDataFrame([tuple(w[k].tolist() for k in shapes)], kinds) for w in layers]
    got = {(x["seq"], x["pos"]): x["logits"] for x in nm.forward(rows, known, weights, H).collect()}
    for b in range(3):
        x = table[ids[b]]
        for w in layers:
            x = layer(x, w)
        for p, want in enumerate(norm(x) @ table.T):
            assert np.allclose(got[b, p], want, atol=1e-9)


def test_linear_takes_a_bias(spark):
    row = spark.range(1).select(nm.linear(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(0.5))).alias("x")).first()
    assert row["x"] == [11.5]


def test_configuration_rules():
    good = {"vocab_size": 100, "d_model": 64, "n_layers": 2, "n_heads": 4, "ffn_dim": 96, "max_seq_len": 32}
    assert nm.validate_model(good) == []
    for change in ({"vocab_size": 0}, {"n_layers": True}, {"d_model": 66}, {"d_model": 4}, {"dropout": 1.5}, {"rope_theta": 0}, {"rms_norm_eps": -1.0}, {"ffn_dim": None}):
        assert len(nm.validate_model(good | change)) == 1, change


def test_training_on_counts_equals_training_on_lines(spark):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdeé"), r.integers(1, 6))) for _ in range(60)]
    lines = [" ".join(r.choice(words, r.integers(1, 12))) for _ in range(300)]
    got = tk.train(spark.createDataFrame([(x,) for x in lines], "line string").repartition(3), vocab_size=120)
    want = tk.blank_tokenizer()
    want.train_from_iterator(lines, tokenizers.trainers.BpeTrainer(vocab_size=120, min_frequency=2, special_tokens=list(tk.SPECIALS), show_progress=False))
    assert got.get_vocab() == want.get_vocab()
    assert [got.encode(x).ids for x in lines] == [want.encode(x).ids for x in lines]


def test_metrics_are_appended(spark, tmp_path):
    one = tmp_path / "a" / "log.jsonl"
    for k in range(3):
        metrics.append_record(str(one), {"step": k, "note": "é"})
    assert [json.loads(x) for x in one.read_text().splitlines()] == [{"step": k, "note": "é"} for k in range(3)]
    folder = str(tmp_path / "rows")
    for k in range(2):
        metrics.append_rows(spark.createDataFrame([(k, None)], "step long, loss double"), folder)
    assert sorted((r["step"], r["loss"]) for r in spark.read.schema("step long, loss double").json(folder).collect()) == [(0, None), (1, None)]
