"""Queries of the numeric operators, over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numeric as nm
from millrace.plans.corpus_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HEADS, LENGTH = 4, 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark, sf_dir):
    """Vectors as doubles; sequences of 16 by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.expr(f"vec_id div {LENGTH}").alias("seq"), (F.col("vec_id") % LENGTH).alias("pos"), F.col("embedding").cast("array<double>").alias("v"))


_E = f"(SELECT vec_id, label, vec_id // {LENGTH} AS seq, vec_id % {LENGTH} AS pos, embedding::DOUBLE[] AS v FROM embeddings)"
_SQ = "list_sum(list_transform({0}, lambda x: x * x))"


def _text(a):
    return F.concat_ws(",", F.transform(a, lambda x: F.format_number(x, 5)))


@query("SELECT s AS step, round(CASE WHEN s < 10 THEN 1e-3 * (s + 1) / 10 WHEN s >= 110 THEN 1e-4 ELSE 1e-4 + (1e-3 - 1e-4) * 0.5 * (1 + cos(3.141592653589793 * (s - 10) / 100.0)) END, 12) AS lr FROM range(150) t(s)")
def lr_schedule(spark, sf_dir):
    return nm.lr_schedule(spark, 150).withColumn("lr", F.round("lr", 12))


_CONFIGS = ((32_000, 512, 8, 1_408, True), (32_000, 512, 8, 1_408, False), (8_000, 128, 2, 512, True))


@query("SELECT *, (v * d + n * (4 * d * d + 3 * d * f + 2 * d) + d + CASE WHEN tied THEN 0 ELSE v * d END)::BIGINT AS parameters FROM (VALUES " + ", ".join(f"({v}::BIGINT, {d}::BIGINT, {n}::BIGINT, {f}::BIGINT, {t})" for v, d, n, f, t in _CONFIGS) + ") AS c(v, d, n, f, tied)")
def param_count(spark, sf_dir):
    rows = spark.createDataFrame(_CONFIGS, "v long, d long, n long, f long, tied boolean")
    return rows.withColumn("parameters", nm.parameter_count(*map(F.col, ("v", "d", "n", "f", "tied"))))


_LSE = "list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))"


@query(f"SELECT vec_id, round({_LSE} - v[label + 1], 8) AS loss FROM {_E}")
def cross_entropy(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", F.round(nm.cross_entropy(F.col("v"), F.col("label")), 8).alias("loss"))


@query(f"WITH l AS (SELECT label, {_LSE} - v[label + 1] AS loss, 1 + vec_id % 5 AS n FROM {_E}), x AS (SELECT sum(loss * n) / sum(n) AS loss FROM l) SELECT round(loss, 8) AS loss, round(CASE WHEN loss < 20 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity FROM x")
def perplexity(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(nm.cross_entropy(F.col("v"), F.col("label")).alias("loss"), (1 + F.col("vec_id") % 5).alias("n"))
    out = rows.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return out.select(F.round("loss", 8).alias("loss"), F.round(nm.perplexity(F.col("loss")), 6).alias("perplexity"))


_FMT = "array_to_string(list_transform({0}, lambda x: printf('%.5f', x)), ',')"


@query(f"SELECT vec_id, round(list_sum(n), 8) AS total, round({_SQ.format('n')}, 6) AS squares FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt({_SQ.format('v')} / len(v) + 1e-6)) AS n FROM {_E})")
def rmsnorm(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("vec_id", nm.rms_norm(F.col("v")).alias("n"))
    return rows.select("vec_id", F.round(nm.total(F.col("n")), 8).alias("total"), F.round(nm.dot(F.col("n"), F.col("n")), 6).alias("squares"))


_H = f"(SELECT vec_id, seq, pos, head, v[head * 16 + 1 : head * 16 + 16] AS x FROM {_E}, (SELECT unnest(range({HEADS})) AS head))"
_ROPE = f"(SELECT vec_id, seq, pos, head, list_transform(range(1, 17), lambda j: CASE WHEN j % 2 = 1 THEN x[j] * cos(pos * pow(10000.0, -2.0 * ((j - 1) // 2) / 16)) - x[j + 1] * sin(pos * pow(10000.0, -2.0 * ((j - 1) // 2) / 16)) ELSE x[j - 1] * sin(pos * pow(10000.0, -2.0 * ((j - 1) // 2) / 16)) + x[j] * cos(pos * pow(10000.0, -2.0 * ((j - 1) // 2) / 16)) END) AS x FROM {_H})"


def _heads(spark, sf_dir, rotate=True):
    rows = nm.heads(_rows(spark, sf_dir), "v", HEADS).select("vec_id", "seq", "pos", F.col("head").cast("long").alias("head"), "x")
    return rows.withColumn("x", nm.rope(F.col("x"), F.col("pos"))) if rotate else rows


@query(f"SELECT vec_id, head, round(list_sum(x), 8) AS total, round(x[1], 8) AS x0, round(x[16], 8) AS x15 FROM {_ROPE}")
def rope(spark, sf_dir):
    return _heads(spark, sf_dir).select("vec_id", "head", F.round(nm.total(F.col("x")), 8).alias("total"), F.round(F.get("x", F.lit(0)), 8).alias("x0"), F.round(F.get("x", F.lit(15)), 8).alias("x15"))


_SC = f"(SELECT q.seq, q.head, q.pos AS q_pos, k.pos AS k_pos, list_sum(list_transform(range(1, 17), lambda j: q.x[j] * k.x[j])) / sqrt(16) AS score FROM {_ROPE} q JOIN {_ROPE} k ON q.seq = k.seq AND q.head = k.head AND k.pos <= q.pos)"


def _scores(spark, sf_dir):
    return nm.causal_scores(_heads(spark, sf_dir), ["seq", "head"])


@query(f"SELECT seq, head, q_pos, k_pos, round(score, 8) AS score FROM {_SC}")
def causal_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 8))


_SM = f"(SELECT seq, head, q_pos, k_pos, exp(score - max(score) OVER w) / sum(e) OVER w AS weight FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY seq, head, q_pos)) AS e FROM {_SC}) WINDOW w AS (PARTITION BY seq, head, q_pos))"


@query(f"SELECT seq, head, q_pos, k_pos, round(weight, 8) AS weight FROM {_SM}")
def causal_softmax(spark, sf_dir):
    return nm.softmax(_scores(spark, sf_dir), ["seq", "head", "q_pos"]).select("seq", "head", "q_pos", "k_pos", F.round("weight", 8).alias("weight"))


@query(f"WITH v AS (SELECT seq, head, pos, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM {_H}) SELECT w.seq, w.head, q_pos, dim::INTEGER AS dim, round(sum(weight * v), 7) AS value FROM {_SM} w JOIN v ON w.seq = v.seq AND w.head = v.head AND w.k_pos = v.pos GROUP BY ALL")
def attention_output(spark, sf_dir):
    weights = nm.softmax(_scores(spark, sf_dir), ["seq", "head", "q_pos"]).select("seq", "head", "q_pos", "k_pos", "weight")
    out = nm.attended(weights, _heads(spark, sf_dir, rotate=False), ["seq", "head"])
    return out.withColumn("value", F.round("value", 7))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda j: v[j] / (1 + exp(-v[j])) * v[j + 32])), 8) AS total FROM {_E}")
def swiglu(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("vec_id", F.round(nm.total(nm.swiglu(F.slice("v", 1, 32), F.slice("v", 33, 32))), 8).alias("total"))


#: Sizes of the layer of the queries below; its parameters follow a rule that both engines know.
WIDTH, FFN = 64, 32
_SHAPES = {"wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "wo": (WIDTH, WIDTH), "gate": (FFN, WIDTH), "up": (FFN, WIDTH), "down": (WIDTH, FFN)}


def _weights(spark, salt=0):
    """One row: the matrices of a layer."""
    def matrix(k, rows, cols):
        one = lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.sin((i * cols + j + 1000 * (k + salt)).cast("double")) / 4)
        return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), one)

    return spark.range(1).select(*[matrix(k, *shape).alias(name) for k, (name, shape) in enumerate(_SHAPES.items())])


def _sql_linear(x, name, salt=0):
    """The product in SQL, each entry of the matrix from its rule."""
    k, (rows, cols) = list(_SHAPES).index(name), _SHAPES[name]
    return f"list_transform(range({rows}), lambda i: list_sum(list_transform(range({cols}), lambda j: {x}[j + 1] * sin((i * {cols} + j + {1000 * (k + salt)})::DOUBLE) / 4)))"


def _sql_norm(x):
    return f"list_transform({x}, lambda z: z / sqrt(list_sum(list_transform({x}, lambda y: y * y)) / len({x}) + 1e-6))"


def _sql_rope(x):
    angle = "pos * pow(10000.0, -2.0 * ((j - 1) // 2) / 16)"
    return f"list_transform(range(1, 17), lambda j: CASE WHEN j % 2 = 1 THEN {x}[j] * cos({angle}) - {x}[j + 1] * sin({angle}) ELSE {x}[j - 1] * sin({angle}) + {x}[j] * cos({angle}) END)"


def _sql_attention(source, p=""):
    """CTEs that end with {p}att(seq, pos, x) over a relation (seq, pos, x)."""
    cut = f"FROM {p}p, (SELECT unnest(range({HEADS})) AS head)"
    side = lambda s: f"{s}[head * 16 + 1 : head * 16 + 16]"
    return f"""{p}p AS (SELECT seq, pos, {_sql_linear('x', 'wq')} AS q, {_sql_linear('x', 'wk')} AS k, {_sql_linear('x', 'wv')} AS v FROM {source}),
{p}h AS (SELECT seq, pos, head, {side('q')} AS q, {side('k')} AS k, {side('v')} AS v {cut}),
{p}r AS (SELECT seq, pos, head, {_sql_rope('q')} AS q, {_sql_rope('k')} AS k, v FROM {p}h),
{p}s AS (SELECT a.seq, a.head, a.pos, b.v, list_sum(list_transform(range(1, 17), lambda j: a.q[j] * b.k[j])) / 4 AS score FROM {p}r a JOIN {p}r b ON a.seq = b.seq AND a.head = b.head AND b.pos <= a.pos),
{p}e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY seq, head, pos)) AS e FROM {p}s),
{p}o AS (SELECT seq, head, pos, generate_subscripts(v, 1) AS dim, unnest(v) * e AS part, e FROM {p}e),
{p}c AS (SELECT seq, pos, head, dim, sum(part) / sum(e) AS value FROM {p}o GROUP BY ALL),
{p}m AS (SELECT seq, pos, list(value ORDER BY head, dim) AS x FROM {p}c GROUP BY ALL),
{p}att AS (SELECT seq, pos, {_sql_linear('x', 'wo')} AS x FROM {p}m)"""


def _sequences(spark, sf_dir):
    return _rows(spark, sf_dir).select("seq", "pos", F.col("v").alias("x"))


_SEQ = f"(SELECT seq, pos, v AS x FROM {_E})"
_SHOW = "SELECT seq, pos, round(list_sum(x), 5) + 0.0::DOUBLE AS total, round(x[1], 6) + 0.0::DOUBLE AS x0, round(x[64], 6) + 0.0::DOUBLE AS x63"  # no negative zero


def _shown(rows):
    shown = {"total": F.round(nm.total(F.col("x")), 5), "x0": F.round(F.get("x", F.lit(0)), 6), "x63": F.round(F.get("x", F.lit(63)), 6)}
    return rows.select("seq", "pos", *[(v + F.lit(0.0)).alias(k) for k, v in shown.items()])


@query(f"WITH p AS (SELECT seq, pos, {_sql_linear('x', 'wq')} AS q, {_sql_linear('x', 'wk')} AS k, {_sql_linear('x', 'wv')} AS v FROM {_SEQ}) SELECT seq, pos, side, head, round(list_sum(x[head * 16 + 1 : head * 16 + 16]), 6) AS total FROM (SELECT seq, pos, unnest(['q', 'k', 'v']) AS side, unnest([q, k, v]) AS x FROM p), (SELECT unnest(range({HEADS})) AS head)")
def qkv_projection(spark, sf_dir):
    sides = nm.qkv(_sequences(spark, sf_dir), _weights(spark), HEADS)
    parts = [rows.select("seq", "pos", F.lit(s).alias("side"), F.col("head").cast("long").alias("head"), F.round(nm.total(F.col("x")), 6).alias("total")) for s, rows in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{_SHOW} FROM {_SEQ}")
def merged_heads(spark, sf_dir):
    cut = nm.heads(_sequences(spark, sf_dir).withColumnRenamed("x", "v"), "v", HEADS).drop("v")
    return _shown(nm.merge_heads(cut, ["seq", "pos"]))


@query(f"WITH {_sql_attention(_SEQ)} {_SHOW} FROM att")
def self_attention(spark, sf_dir):
    return _shown(nm.attention(_sequences(spark, sf_dir), _weights(spark), HEADS))


_GATED = f"(SELECT seq, pos, x, {_sql_linear('n', 'gate')} AS g, {_sql_linear('n', 'up')} AS u FROM {{0}})"
_FFN = f"(SELECT seq, pos, x, {_sql_linear('h', 'down')} AS f FROM (SELECT seq, pos, x, list_transform(range(1, {FFN + 1}), lambda j: g[j] / (1 + exp(-g[j])) * u[j]) AS h FROM {_GATED}))"


@query(f"{_SHOW} FROM (SELECT seq, pos, f AS x FROM {_FFN.format(f'(SELECT seq, pos, x, x AS n FROM {_SEQ})')})")
def swiglu_ffn(spark, sf_dir):
    rows = _sequences(spark, sf_dir).crossJoin(F.broadcast(_weights(spark)))
    return _shown(rows.select("seq", "pos", nm.swiglu_ffn(F.col("x"), F.col("gate"), F.col("up"), F.col("down")).alias("x")))


_MID = f"(SELECT s.seq, s.pos, list_transform(range(1, {WIDTH + 1}), lambda j: s.x[j] + a.x[j]) AS x FROM {_SEQ} s JOIN att a ON s.seq = a.seq AND s.pos = a.pos)"


@query(f"WITH {_sql_attention(f'(SELECT seq, pos, {_sql_norm(chr(120))} AS x FROM {_SEQ})')}, mid AS {_MID}, f AS {_FFN.format(f'(SELECT seq, pos, x, {_sql_norm(chr(120))} AS n FROM mid)')}, y AS (SELECT seq, pos, list_transform(range(1, {WIDTH + 1}), lambda j: x[j] + f[j]) AS x FROM f) {_SHOW} FROM y")
def transformer_block(spark, sf_dir):
    return _shown(nm.block(_sequences(spark, sf_dir), _weights(spark), HEADS))


def _gain_row(spark, *names):
    """One row: the gains of norms, by a rule that both engines know."""
    one = lambda k: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: 1 + F.sin((j + k).cast("double")) / 8)
    return spark.range(1).select(*[one(_GAINS[n]).alias(n) for n in names])


NORM1 = "norm1"
_GAINS = {"norm1": 1, "norm2": 2, "gain": 3}


def _sql_scaled(x, name):
    return f"list_transform(range({WIDTH}), lambda g: ({_sql_norm(x)})[g + 1] * (1 + sin((g + {_GAINS[name]})::DOUBLE) / 8))"


@query(f"SELECT vec_id, round(list_sum(n), 7) AS total, round({_SQ.format('n')}, 6) AS squares FROM (SELECT vec_id, {_sql_scaled('v', 'gain')} AS n FROM {_E})")
def rmsnorm_gain(spark, sf_dir):
    rows = _rows(spark, sf_dir).crossJoin(F.broadcast(_gain_row(spark, "gain"))).select("vec_id", nm.rms_norm(F.col("v"), gain=F.col("gain")).alias("n"))
    return rows.select("vec_id", F.round(nm.total(F.col("n")), 7).alias("total"), F.round(nm.dot(F.col("n"), F.col("n")), 6).alias("squares"))


def _layer(spark):
    return _weights(spark).crossJoin(_gain_row(spark, "norm1", "norm2"))


def _sql_layer(source):
    """CTEs that end with y(seq, pos, x): one layer with gains over a relation (seq, pos, x)."""
    mid = f"(SELECT s.seq, s.pos, list_transform(range(1, {WIDTH + 1}), lambda j: s.x[j] + a.x[j]) AS x FROM {source} s JOIN att a ON s.seq = a.seq AND s.pos = a.pos)"
    ffn = _FFN.format(f"(SELECT seq, pos, x, {_sql_scaled('x', 'norm2')} AS n FROM mid)")
    return f"{_sql_attention(f'(SELECT seq, pos, {_sql_scaled(chr(120), NORM1)} AS x FROM {source})')}, mid AS {mid}, f AS {ffn}, y AS (SELECT seq, pos, list_transform(range(1, {WIDTH + 1}), lambda j: x[j] + f[j]) AS x FROM f)"


@query(f"WITH {_sql_layer(_SEQ)} {_SHOW} FROM y")
def transformer_block_gain(spark, sf_dir):
    return _shown(nm.block(_sequences(spark, sf_dir), _layer(spark), HEADS))


#: Tokens of the model's vocabulary; their vectors follow a rule, as its other parameters do.
VOCABULARY = 300
_TABLE = f"(SELECT token, list_transform(range({WIDTH}), lambda j: sin((token * {WIDTH} + j)::DOUBLE)) AS x FROM range({VOCABULARY}) t(token))"
_TOKENS = f"(SELECT seq, pos, x FROM (SELECT seq, pos, vec_id * 7 % {VOCABULARY} AS token FROM {_E}) JOIN {_TABLE} USING (token))"


def _sql_forward(head):
    logits = f"SELECT seq, pos, list(list_sum(list_transform(range(1, {WIDTH + 1}), lambda j: z.n[j] * h.x[j])) ORDER BY h.token) AS logits FROM (SELECT seq, pos, {_sql_scaled('x', 'gain')} AS n FROM y) z, {head} h GROUP BY ALL"
    return f"WITH {_sql_layer(_TOKENS)}, l AS ({logits}) SELECT seq, pos, len(logits)::INTEGER AS n, round(list_sum(logits), 4) + 0.0::DOUBLE AS total, round(list_max(logits), 5) + 0.0::DOUBLE AS most, round(logits[1], 5) + 0.0::DOUBLE AS first FROM l"


def _forward(spark, sf_dir, tied):
    table = spark.range(VOCABULARY).select(F.col("id").alias("token"), F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.sin((F.col("id") * WIDTH + j).cast("double"))).alias("x"))
    head = None if tied else table.select("token", F.transform("x", lambda x, j: x * F.cos((F.col("token") + j).cast("double"))).alias("x"))
    tokens = _rows(spark, sf_dir).select("seq", "pos", (F.col("vec_id") * 7 % VOCABULARY).alias("token"))
    found = nm.forward(tokens, table, [_layer(spark)], HEADS, gain=_gain_row(spark, "gain"), head=head, height=64)
    shown = {"total": F.round(nm.total(F.col("logits")), 4), "most": F.round(F.array_max("logits"), 5), "first": F.round(F.get("logits", F.lit(0)), 5)}
    return found.select("seq", "pos", F.size("logits").alias("n"), *[(v + F.lit(0.0)).alias(k) for k, v in shown.items()])


@query(_sql_forward(_TABLE))
def forward_tied(spark, sf_dir):
    return _forward(spark, sf_dir, True)


@query(_sql_forward(f"(SELECT token, list_transform(range(1, {WIDTH + 1}), lambda j: x[j] * cos((token + j - 1)::DOUBLE)) AS x FROM {_TABLE})"))
def forward_untied(spark, sf_dir):
    return _forward(spark, sf_dir, False)


@query("SELECT event_id, label, round(embedding[1]::DOUBLE, 9) AS x0 FROM events JOIN embeddings ON user_id = vec_id")
def embedding_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("event_id", "user_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 9).alias("x0"))
    return ids.join(rows, "user_id").select("event_id", "label", "x0")


@query("SELECT round((SELECT avg(value) FROM (SELECT value FROM events ORDER BY event_id LIMIT 50)), 9) AS first_mean, round((SELECT avg(value) FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 50)), 9) AS last_mean")
def window_means(spark, sf_dir):
    out = nm.window_means(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 50)
    return out.select(F.round("first_mean", 9).alias("first_mean"), F.round("last_mean", 9).alias("last_mean"))


@query(f"SELECT label, round(sqrt(sum({_SQ.format('v')})), 8) AS norm, round(least(1.0, 1.0 / (sqrt(sum({_SQ.format('v')})) + 1e-6)), 8) AS clip FROM {_E} GROUP BY label")
def grad_norm(spark, sf_dir):
    rows = _rows(spark, sf_dir).groupBy("label").agg(F.sqrt(F.sum(nm.dot(F.col("v"), F.col("v")))).alias("n"))
    return rows.select("label", F.round("n", 8).alias("norm"), F.round(F.least(F.lit(1.0), 1.0 / (F.col("n") + 1e-6)), 8).alias("clip"))


@query(f"SELECT count(*)::BIGINT AS n, round(avg((list_position(v, list_max(v)) - 1 = label)::INTEGER), 9) AS accuracy FROM {_E}")
def accuracy(spark, sf_dir):
    hit = (nm.argmax(F.col("v")) == F.col("label")).cast("int")
    return _rows(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(hit), 9).alias("accuracy"))


@query("SELECT user_id AS step, round(avg(value), 9) AS mean_loss, count(*)::BIGINT AS micro_batches FROM events GROUP BY user_id")
def step_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("step")).agg(F.round(F.avg("value"), 9).alias("mean_loss"), F.count("*").alias("micro_batches"))


@query("WITH l AS (SELECT event_id // 100 AS log, count(*) AS tokens, epoch(max(ts)) AS t FROM events GROUP BY 1) SELECT log, tokens::BIGINT AS tokens, round(tokens / nullif(t - lag(t) OVER (ORDER BY log), 0), 6) AS per_second FROM l")
def throughput(spark, sf_dir):
    """Tokens since the last log step over the time since then."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.expr("event_id div 100").alias("log")).agg(F.count("*").alias("tokens"), (F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.orderBy("log"))  # one row for each log step
    return rows.select("log", "tokens", F.round(F.try_divide(F.col("tokens").cast("double"), gap), 6).alias("per_second"))


_PARAMS = (("tok.weight", 2, 1), ("attn.w", 2, 2), ("norm.g", 1, 3), ("head.weight", 2, 1), ("bias", 1, 4))


@query("SELECT name, CASE WHEN rank >= 2 THEN 'decay' ELSE 'no_decay' END AS grp FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY k) AS rn FROM (VALUES " + ", ".join(f"({k}, '{n}', {r}, {i})" for k, (n, r, i) in enumerate(_PARAMS)) + ") AS p(k, name, rank, identity)) WHERE rn = 1")
def param_groups(spark, sf_dir):
    """Weight decay by rank; parameters that are one and the same count once."""
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(_PARAMS)], "k int, name string, rank int, identity int")
    once = rows.groupBy("identity").agg(F.min_by(F.struct("name", "rank"), "k").alias("p"))
    return once.select("p.name", F.when(F.col("p.rank") >= 2, "decay").otherwise("no_decay").alias("grp"))
