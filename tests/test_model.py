"""Norm gains, attention by blocks, products of blocked matrices and the whole pass, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric as nm


def softmax(s):
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def normed(x, gain=1.0):
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6) * gain


def turned(x, theta=10_000.0):
    pos, size = np.arange(x.shape[0])[:, None], x.shape[1]
    angle = pos * theta ** (-2.0 * np.arange(size // 2) / size)
    out = np.empty_like(x)
    out[:, 0::2] = x[:, 0::2] * np.cos(angle) - x[:, 1::2] * np.sin(angle)
    out[:, 1::2] = x[:, 0::2] * np.sin(angle) + x[:, 1::2] * np.cos(angle)
    return out


def causal(q, k, v):
    scores = q @ k.T / np.sqrt(q.shape[1])
    scores[np.triu_indices(len(q), 1)] = -np.inf
    return softmax(scores) @ v


def layer(x, w, count):
    n = normed(x, w["norm1"])
    q, k, v = (n @ w[s].T for s in ("wq", "wk", "wv"))
    size = x.shape[1] // count
    parts = [causal(turned(q[:, a : a + size]), turned(k[:, a : a + size]), v[:, a : a + size]) for a in range(0, x.shape[1], size)]
    x = x + np.concatenate(parts, 1) @ w["wo"].T
    n = normed(x, w["norm2"])
    g = n @ w["gate"].T
    return x + (g / (1 + np.exp(-g)) * (n @ w["up"].T)) @ w["down"].T


def one_row(spark, arrays):
    kinds = ", ".join(f"{k} array<{'array<double>' if v.ndim == 2 else 'double'}>" for k, v in arrays.items())
    return spark.createDataFrame([tuple(v.tolist() for v in arrays.values())], kinds)


def test_gain_scales_each_place(spark):
    x, g = np.array([1.0, -2.0, 3.0]), np.array([2.0, 0.0, -1.0])
    row = spark.createDataFrame([(x.tolist(), g.tolist())], "x array<double>, g array<double>").select(nm.rms_norm(F.col("x"), gain=F.col("g")).alias("y"), nm.rms_norm(F.col("x")).alias("z")).first()
    assert np.allclose(row["y"], normed(x, g)) and np.allclose(row["z"], normed(x))


@pytest.mark.parametrize("block", [1, 3, 4, 64])
def test_attention_by_blocks_equals_the_full_matrix(spark, block):
    r = np.random.default_rng(block)
    lengths = {1: 10, 2: 1, 3: 7}
    vectors = {s: [r.normal(size=(n, d)) * 30 for d in (4, 4, 3)] for s, n in lengths.items()}  # scores far apart: the maxima matter
    rows = [(s, p, *[v[p].tolist() for v in vs]) for s, vs in vectors.items() for p in range(lengths[s])]
    table = spark.createDataFrame(rows, "seq int, pos int, q array<double>, k array<double>, v array<double>").repartition(3)
    out = nm.attend(table, ["seq"], block)
    for row in out.collect():
        assert np.allclose(row["x"], causal(*vectors[row["seq"]])[row["pos"]], atol=1e-9), row
    assert out.count() == sum(lengths.values())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 2  # the rows by their keys, on both sides of the join


@pytest.mark.parametrize(("height", "width", "copies"), [(2, 3, 4), (5, 7, 1), (100, 100, 3), (1, 1, 2)])
def test_products_of_blocked_matrices(spark, height, width, copies):
    r = np.random.default_rng(3)
    m, x = r.normal(size=(5, 7)), r.normal(size=(6, 7))
    matrix = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "row long, x array<double>")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, x array<double>")
    got = {}
    for row in nm.product(rows, nm.matrix_blocks(matrix, height, width), ["k"], width, copies).collect():
        assert (row["k"], row["i"]) not in got and len(row["y"]) == min(height, 5 - row["i"] * height)
        got[row["k"], row["i"]] = row["y"]
    for k in range(6):
        assert np.allclose(np.concatenate([got[k, i] for i in range(-(-5 // height))]), m @ x[k])
    assert nm.product(rows.limit(0), nm.matrix_blocks(matrix, height, width), ["k"], width, copies).count() == 0


@pytest.mark.parametrize("tied", [True, False])
def test_the_whole_pass(spark, tied):
    r = np.random.default_rng(5)
    width, ffn, vocabulary, count = 8, 6, 11, 2
    shapes = {"wq": (width, width), "wk": (width, width), "wv": (width, width), "wo": (width, width), "gate": (ffn, width), "up": (ffn, width), "down": (width, ffn), "norm1": (width,), "norm2": (width,)}
    layers = [{k: r.normal(size=s) for k, s in shapes.items()} for _ in range(2)]
    table, head, gain = r.normal(size=(vocabulary, width)), r.normal(size=(vocabulary, width)), r.normal(size=width)
    said = {0: [1, 5, 5, 10, 0], 1: [3]}
    vectors = lambda t: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(t)], "token int, x array<double>")
    tokens = spark.createDataFrame([(s, p, t) for s, ts in said.items() for p, t in enumerate(ts)], "seq int, pos int, token int")
    asked = dict(gain=one_row(spark, {"gain": gain}), head=None if tied else vectors(head), height=4)  # noqa: C408
    rows = [one_row(spark, w) for w in layers]
    got = {(x["seq"], x["pos"]): x["logits"] for x in nm.forward(tokens, vectors(table), rows, count, **asked).collect()}
    for s, ts in said.items():
        x = table[ts]
        for w in layers:
            x = layer(x, w, count)
        want = normed(x, gain) @ (table if tied else head).T
        assert np.allclose([got[s, p] for p in range(len(ts))], want, atol=1e-8)
    blocks = nm.forward(tokens, vectors(table), rows, count, blocked=True, **asked).collect()
    assert len(blocks) == 6 * 3 and all(b["y"] == got[b["seq"], b["pos"]][b["i"] * 4 : b["i"] * 4 + 4] for b in blocks)
