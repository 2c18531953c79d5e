"""Closed-form numeric operators over array columns and relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import once


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and however deep it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rms_norm(x: Column, eps: float = 1e-6, gain: Column | None = None) -> Column:
    """x over the root of its mean square, times the learned gain of each place if there is one."""
    normed = let(x, lambda y: let(F.sqrt(dot(y, y) / F.size(y) + F.lit(eps)), lambda scale: F.transform(y, lambda v: v.cast("double") / scale)))
    return normed if gain is None else F.zip_with(normed, gain, lambda v, g: v * g.cast("double"))


def rope(x: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Rotates adjacent pairs by the position times theta to the power -2i / size."""

    def turned(x: Column) -> Column:
        def one(v: Column, j: Column) -> Column:
            pair = F.floor(j / 2)
            angle = position.cast("double") * F.pow(F.lit(theta), -2.0 * pair / F.size(x))
            other = F.get(x, F.when(j % 2 == 0, j + 1).otherwise(j - 1)).cast("double")
            v = v.cast("double")
            return F.when(j % 2 == 0, v * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + v * F.cos(angle))

        return F.transform(x, one)

    return let(x, turned)


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x).cast("double"), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v.cast("double") - top)))))


def cross_entropy(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, label.cast("int")).cast("double")


def argmax(x: Column) -> Column:
    """The first place of the maximum, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(gate: Column, up: Column) -> Column:
    """The gated product of two projections."""
    return F.zip_with(gate, up, lambda g, u: silu(g.cast("double")) * u.cast("double"))


def linear(x: Column, weight: Column, bias: Column | None = None) -> Column:
    """The rows of a matrix times a vector, plus a bias if there is one."""
    out = let(x, lambda v: F.transform(weight, lambda row: dot(row, v)))
    return out if bias is None else add(out, bias)


def add(a: Column, b: Column) -> Column:
    """The sum of two vectors."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def swiglu_ffn(x: Column, gate: Column, up: Column, down: Column) -> Column:
    """The feed-forward layer: two projections, their gated product, a third projection."""
    return linear(swiglu(linear(x, gate), linear(x, up)), down)


def perplexity(loss: Column) -> Column:
    return F.when(loss < 20, F.exp(loss)).otherwise(F.lit(float("inf")))


def lr_schedule(spark: SparkSession, steps: int, peak: float = 1e-3, least: float = 1e-4, warmup: int = 10, total_steps: int = 110) -> DataFrame:
    """(step, lr): linear warm-up, cosine decay, then the floor."""
    step = F.col("id").cast("double")
    share = (step - warmup) / max(total_steps - warmup, 1)
    decay = F.lit(least) + (F.lit(peak) - F.lit(least)) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share))
    lr = F.when(F.col("id") < warmup, F.lit(peak) * (step + 1) / max(warmup, 1)).when(F.col("id") >= total_steps, F.lit(least)).otherwise(decay)
    return spark.range(steps).select(F.col("id").alias("step"), lr.alias("lr"))


def parameter_count(v: Column, d: Column, layers: Column, ffn: Column, tied: Column) -> Column:
    """Parameters of a decoder with gated feed-forward layers."""
    body = v * d + layers * (4 * d * d + 3 * d * ffn + 2 * d) + d
    return body + F.when(tied, F.lit(0)).otherwise(v * d)


def heads(vectors: DataFrame, vector: str, count: int) -> DataFrame:
    """A row for each head: its number and its slice of the vector."""
    size = F.expr(f"size({vector}) div {count}")
    cut = vectors.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return cut.withColumn("x", once(F.slice(vector, F.col("head") * size + 1, size)))


def merge_heads(parts: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The inverse of ``heads``: a row for each of the keys, the heads' vectors end to end."""
    ordered = F.array_sort(F.collect_list(F.struct("head", value)))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda h: h[value])).alias(value))


def causal_scores(rows: DataFrame, keys: list[str], key_rows: DataFrame | None = None) -> DataFrame:
    """(*keys, q_pos, k_pos, score): scaled products of each query with the keys not after it.
    Queries and keys are the same vectors unless ``key_rows`` are given."""
    q = rows.select(*keys, F.col("pos").alias("q_pos"), F.col("x").alias("q"))
    k = (key_rows if key_rows is not None else rows).select(*keys, F.col("pos").alias("k_pos"), F.col("x").alias("k"))
    seen = q.join(k, keys).filter("k_pos <= q_pos")
    return seen.select(*keys, "q_pos", "k_pos", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("score"))


def softmax(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Adds weight: the softmax of the score within the keys."""
    own = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(own))
    return scores.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(own)).drop("e")


def attended(weights: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, q_pos, dim, value): sums of the values by weight."""
    v = rows.select(*keys, F.col("pos").alias("k_pos"), F.posexplode("x").alias("dim", "v"))
    return weights.join(v, [*keys, "k_pos"]).groupBy(*keys, "q_pos", "dim").agg(F.sum(F.col("weight") * F.col("v").cast("double")).alias("value"))


def _seen(query: Column, keys: Column) -> Column:
    """What a query gathers from a block of keys that are not after it: the greatest score, the sum of
    the exponentials under it, and the values weighted by them."""

    def gather(near: Column) -> Column:
        scores = F.transform(near, lambda k: dot(query["q"], k["k"]) / F.sqrt(F.size(query["q"])))

        def under(s: Column) -> Column:
            def state(top: Column) -> Column:
                weighted = F.zip_with(s, near, lambda x, k: F.struct(F.exp(x - top).alias("w"), k["v"].alias("v")))

                def sums(parts: Column) -> Column:
                    none = F.transform(F.get(parts, F.lit(0))["v"], lambda _: F.lit(0.0))
                    total_of = F.aggregate(parts, none, lambda acc, p: F.zip_with(acc, p["v"], lambda x, y: x + p["w"] * y.cast("double")))
                    return F.struct(query["pos"].alias("pos"), top.alias("top"), total(F.transform(parts, lambda p: p["w"])).alias("sum"), total_of.alias("x"))

                return let(weighted, sums)

            return let(F.array_max(s), state)

        return let(scores, under)

    return let(F.filter(keys, lambda k: k["pos"] <= query["pos"]), gather)


def _together(a: Column, b: Column) -> Column:
    """Two such states as one, under the greater of their greatest scores."""

    def under(top: Column) -> Column:
        p, q = F.exp(a["top"] - top), F.exp(b["top"] - top)
        return F.struct(a["pos"].alias("pos"), top.alias("top"), (a["sum"] * p + b["sum"] * q).alias("sum"), F.zip_with(a["x"], b["x"], lambda x, y: x * p + y * q).alias("x"))

    return let(F.greatest(a["top"], b["top"]), under)


def attend(rows: DataFrame, keys: list[str], block: int = 1024) -> DataFrame:
    """(*keys, pos, x): causal attention of rows (*keys, pos, q, k, v) by an online softmax.

    Positions lie in blocks; a block of queries meets the blocks of keys up to its own, and gathers
    from each a running state (maximum, sum, weighted values); the states of a query are added up. No row is
    made for a pair of positions: up to ``block`` positions a sequence is one row, a longer one
    n(n + 1) / 2 rows of n blocks. One shuffle, by the keys, into as many tasks as are set: few bytes take long here."""
    own = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("at", F.expr(f"pos div {block}"))
    cut = own.groupBy(*keys, "at").agg(F.array_sort(F.collect_list(F.struct("pos", "q", "k", "v"))).alias("t"))
    q = cut.select(*keys, F.col("at").alias("q_at"), F.transform("t", lambda r: F.struct(r["pos"].alias("pos"), r["q"].alias("q"))).alias("q"))
    k = cut.select(*keys, F.col("at").alias("k_at"), F.transform("t", lambda r: F.struct(r["pos"].alias("pos"), r["k"].alias("k"), r["v"].alias("v"))).alias("k"))
    met = q.join(k, keys).filter("k_at <= q_at")
    states = met.select(*keys, "q_at", F.struct("k_at", F.transform("q", lambda one: _seen(one, F.col("k"))).alias("s")).alias("s"))
    listed = states.groupBy(*keys, "q_at").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["s"]).alias("s"))
    whole = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, _together))
    done = listed.select(*keys, F.explode(whole).alias("s"))
    return done.select(*keys, F.col("s.pos").alias("pos"), F.transform("s.x", lambda x: x / F.col("s.sum")).alias("x"))


def qkv(rows: DataFrame, weights: DataFrame, count: int) -> dict[str, DataFrame]:
    """Queries, keys and values by head: (seq, pos, head, x) of each. ``weights`` is one row
    with the matrices wq, wk and wv: a layer's parameters, whose size the model bounds."""
    both = rows.crossJoin(F.broadcast(weights))
    return {side: heads(both.select("seq", "pos", once(linear(F.col("x"), F.col(f"w{side}"))).alias("v")), "v", count).select("seq", "pos", "head", "x") for side in "qkv"}


def attention(rows: DataFrame, weights: DataFrame, count: int, theta: float = 10_000.0, block: int = 1024) -> DataFrame:
    """(seq, pos, x): causal self-attention with rotated queries and keys and an output projection wo."""
    both = rows.crossJoin(F.broadcast(weights))
    sides = both.select("seq", "pos", *[once(linear(F.col("x"), F.col(f"w{s}"))).alias(s) for s in "qkv"])
    size = F.expr(f"size(q) div {count}")
    cut = sides.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    own = cut.select("seq", "pos", "head", *[once(F.slice(s, F.col("head") * size + 1, size)).alias(s) for s in "qkv"])
    turned = own.withColumns({s: once(rope(F.col(s), F.col("pos"), theta)) for s in "qk"})
    merged = merge_heads(attend(turned, ["seq", "head"], block), ["seq", "pos"]).crossJoin(F.broadcast(weights))
    return merged.select("seq", "pos", linear(F.col("x"), F.col("wo")).alias("x"))


def _gain(weights: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in weights.columns else None


def block(rows: DataFrame, weights: DataFrame, count: int, eps: float = 1e-6, theta: float = 10_000.0) -> DataFrame:
    """(seq, pos, x): a pre-norm layer, each branch added to what it reads. The gains of its two
    norms are the columns norm1 and norm2 of the weights; without them they are 1."""
    gains = [c for c in ("norm1", "norm2") if c in weights.columns]
    scaled = rows.crossJoin(F.broadcast(weights.select(*gains[:1]))) if "norm1" in gains else rows
    normed = scaled.select("seq", "pos", once(rms_norm(F.col("x"), eps, _gain(weights, "norm1"))).alias("x"))
    seen = attention(normed, weights, count, theta).withColumnRenamed("x", "a")
    mid = rows.join(seen, ["seq", "pos"]).select("seq", "pos", once(add(F.col("x"), F.col("a"))).alias("x")).crossJoin(F.broadcast(weights))
    ffn = swiglu_ffn(rms_norm(F.col("x"), eps, _gain(weights, "norm2")), F.col("gate"), F.col("up"), F.col("down"))
    return mid.select("seq", "pos", add(F.col("x"), ffn).alias("x"))


def matrix_blocks(matrix: DataFrame, height: int = 1024, width: int = 1024) -> DataFrame:
    """(i, j, m) of a matrix given by rows (row, x): its blocks of ``height`` rows and ``width`` columns."""
    wide = F.expr(f"sequence(0, (size(x) - 1) div {width})")
    cut = matrix.select("row", F.explode(wide).alias("j"), "x").select(F.expr(f"row div {height}").alias("i"), "j", F.struct("row", F.slice("x", F.col("j") * width + 1, width).alias("x")).alias("r"))
    return cut.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("m"))


def product(rows: DataFrame, blocks: DataFrame, keys: list[str], width: int = 1024, copies: int | None = None) -> DataFrame:
    """(*keys, i, y): the blocks of a matrix times the vector x of each row, as blocks of the result.

    A vector is cut as the matrix's columns are, and its pieces meet the blocks of their columns. These
    are few keys, so rows are salted and blocks sent ``copies`` times: no task has all rows of a piece,
    and no row or task holds the matrix."""
    copies = copies or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*keys), F.lit(copies)).alias("salt")
    pieces = rows.select(*keys, salt, F.expr(f"posexplode(transform(sequence(0, (size(x) - 1) div {width}), j -> slice(x, j * {width} + 1, {width})))").alias("j", "x"))
    sent = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    part = pieces.join(sent, ["j", "salt"]).select(*keys, "i", "j", linear(F.col("x"), F.col("m")).alias("y"))
    listed = part.groupBy(*keys, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda p: p["y"]).alias("p"))  # one for each piece of the vector
    whole = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0)), add)
    return listed.select(*keys, "i", whole.alias("y"))


def forward(
    tokens: DataFrame, table: DataFrame, layers: list[DataFrame], count: int, eps: float = 1e-6, theta: float = 10_000.0,
    gain: DataFrame | None = None, head: DataFrame | None = None, height: int = 1024, blocked: bool = False,
) -> DataFrame:
    """(seq, pos, logits): token vectors through the layers, the last norm and the output.

    ``tokens`` has (seq, pos, token), ``table`` (token, x) with tokens from 0 on. ``gain`` is one row
    with the last norm's ``gain``. ``head`` is a table of the output's own vectors; without one the output is tied
    to ``table``. The vocabulary stays a relation: logits are made by blocks of ``height`` tokens. With ``blocked`` they
    stay so: (seq, pos, i, y), y being the logits of the tokens from i * height on."""
    rows = tokens.join(table, "token").select("seq", "pos", F.col("x").cast("array<double>").alias("x"))
    for weights in layers:
        rows = block(rows, weights, count, eps, theta)
    last = rows if gain is None else rows.crossJoin(F.broadcast(gain.select("gain")))
    normed = last.select("seq", "pos", once(rms_norm(F.col("x"), eps, None if gain is None else F.col("gain"))).alias("x"))
    out = product(normed, matrix_blocks((table if head is None else head).select(F.col("token").alias("row"), "x"), height), ["seq", "pos"])
    if blocked:
        return out
    return out.groupBy("seq", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda b: b["y"])).alias("logits"))


def window_means(history: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """One row: the means of the first and of the last ``width`` values."""
    first = history.orderBy(order).limit(width).agg(F.avg(value).alias("first_mean"))
    last = history.orderBy(F.desc(order)).limit(width).agg(F.avg(value).alias("last_mean"))
    return first.crossJoin(last)


def validate_model(config: dict) -> list[str]:
    """What is wrong with a model's configuration."""
    out = [f"{k} must be a positive integer" for k in ("vocab_size", "d_model", "n_layers", "n_heads", "ffn_dim", "max_seq_len") if not isinstance(config.get(k), int) or isinstance(config.get(k), bool) or config[k] <= 0]
    if not 0 <= config.get("dropout", 0.0) <= 1:
        out.append("dropout must be in [0, 1]")
    out += [f"{k} must be positive" for k in ("rope_theta", "rms_norm_eps") if config.get(k, 1) <= 0]
    if not out and config["d_model"] % config["n_heads"]:
        out.append("d_model must be divisible by n_heads")
    elif not out and config["d_model"] // config["n_heads"] % 2:
        out.append("the size of a head must be even")
    return out
