"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filtered at several widths, rectified and max-pooled over windows
of a fixed length; a softmax follows. A text is cut into windows from its first byte to
its last, and its label is that of the mean log-probability over all of them. For
prediction the embedding is folded into one table for each filter position.

The network is fitted on at most ``per_label`` documents of each label (a documented
bound), taken by a hash of the id, and on at most ``windows_per_doc`` windows of each of
them; prediction reads every byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows
without label are predicted but not learned from; with no labelled row at all every
text is ``und``; repeated rows are predicted each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, small_batches, text_of, utf8

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
UNKNOWN = "und"
#: Steps of a score, from 0 to 1, in which the held-out fold is judged.
SCORE_STEPS = 10_000
#: Windows that go through the network at once.
BATCH = 256
#: Labels that a network may learn; more is an error, not a silent loss.
MOST_LABELS = 512
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows by size bytes, text number of each): texts end to end, padded with 0."""
    lens = np.diff(offsets)
    n = -(-lens // size)
    row = np.repeat(np.arange(len(lens)), n)
    out = np.zeros(int(n.sum()) * size, np.uint8)
    first = (np.cumsum(n) - n) * size
    at = np.arange(len(data), dtype=np.int64) + np.repeat(first - offsets[:-1], lens)
    out[at] = _FOLD[data]
    return out.reshape(-1, size), row


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def _patches(self, x: np.ndarray, w: int) -> np.ndarray:
        e = self.p["e"][x]
        n = x.shape[1] - w + 1
        return np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch; only the place of each maximum passes a gradient."""
        pooled, where = [], {}
        for w in WIDTHS:
            z = self._patches(x, w) @ self.p[f"w{w}"] + self.p[f"b{w}"]
            where[w] = z.argmax(1)
            pooled.append(np.take_along_axis(z, where[w][:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        logits = a @ self.p["out"] + self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        n = len(y)
        loss = float(-np.log(q[np.arange(n), y] + 1e-9).mean())
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": a.T @ q, "bias": q.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (q @ self.p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            at = where[w][:, :, None] + np.arange(w)  # batch, filter, position
            raw = x[np.arange(n)[:, None, None], at]
            patch = self.p["e"][raw].reshape(n, FILTERS, -1)
            g[f"w{w}"] = np.einsum("bf,bfd->df", d, patch)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(g["e"], raw, back)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteNet:
        """Adam over shuffled batches; the step shrinks with the epochs."""
        r, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick = order[lo : lo + batch]
                _, g = self.step(x[pick], y[pick])
                t += 1
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def folded(self) -> dict[int, np.ndarray]:
        """For each width a table (position, byte, filter): embedding and filter in one."""
        return {w: np.einsum("ve,wef->wvf", self.p["e"], self.p[f"w{w}"].reshape(w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}

    def log_probs(self, x: np.ndarray, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Log-probabilities of windows by label."""
        tables = tables or self.folded()
        out = np.empty((len(x), len(self.labels)), np.float32)
        for lo in range(0, len(x), BATCH):
            part = x[lo : lo + BATCH].astype(np.intp)
            pooled = []
            for w in WIDTHS:
                n = part.shape[1] - w + 1
                z = tables[w][0].take(part[:, :n], 0)
                for k in range(1, w):
                    z += tables[w][k].take(part[:, k : k + n], 0)
                pooled.append(z.max(1) + self.p[f"b{w}"])
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]
            logits -= logits.max(1, keepdims=True)
            out[lo : lo + BATCH] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 400, windows_per_doc: int = 8, most: int = 20_000) -> ByteNet | None:
    """Fits a network on at most ``per_label`` documents of each label and ``most`` of all, the first by a hash of
    the id. Of each the driver gets ``windows_per_doc`` windows, cut by the executors: 2 kB, however long it is."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull())
    counts = labelled.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n")).orderBy("l").limit(MOST_LABELS + 1).collect()
    if not counts:
        return None
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    per_label = max(1, min(per_label, most // len(counts)))
    place = F.pmod(F.xxhash64(F.lit("fit"), F.col(id)), F.lit(1 << 20))
    reach = F.lit(False)
    for r in counts:  # a share of each label that holds about twice the bound
        reach = reach | ((F.col(label) == r["l"]) & (place < F.lit(min(1 << 20, (1 << 20) * 2 * per_label // r["n"] + 64))))
    kind = docs.schema[id].dataType.simpleString()
    keyed = labelled.filter(reach).select(F.col(label).alias("l"), F.xxhash64(F.lit("fit"), F.col(id)).alias("h"), F.col(id).alias("id"), F.col(text).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            some = np.flatnonzero(np.diff(offsets))
            picked = []
            for k in some:
                x, _ = windows_of(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k])
                r = np.random.default_rng([3, batch.column("h")[k].as_py() & ((1 << 63) - 1)])
                x = x[r.permutation(len(x))[:windows_per_doc]].copy()
                if r.random() < 0.5:  # short texts must be known too
                    x[0, int(r.integers(16, WINDOW)) :] = 0
                picked.append(x.tobytes())
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept.column("l"), kept.column("h"), kept.column("id"), pa.array(picked, pa.binary())], ["l", "h", "id", "x"])

    small_batches(docs.sparkSession)
    cut_rows = in_arrow(keyed, cut, f"l string, h long, id {kind}, x binary")  # a few windows of a text: no text is sorted or sent
    rows = cut_rows.orderBy("h", "id", "x").limit(4 * per_label * len(counts)).toPandas()
    rows = rows.groupby("l", sort=True).head(per_label)
    labels = sorted(rows["l"].unique())
    xs = [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in rows["x"]]
    ys = [labels.index(lang) for lang, x in zip(rows["l"], xs, strict=True) for _ in x]
    return ByteNet(labels).fit(np.concatenate(xs), np.array(ys)) if xs else None


def has_letter(data: bytes) -> bool:
    """Whether a text holds a letter of any script."""
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


def predict(docs: DataFrame, net: ByteNet | None, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of every row; score is the mean probability of the label."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.folded() if net else None
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            n = len(offsets) - 1
            total = np.zeros((n, len(net.labels) if net else 1))
            seen = np.zeros_like(total)
            ascii_letter = (_FOLD[data] >= 0x61) & (_FOLD[data] <= 0x7A)
            count = np.concatenate([[0], np.cumsum(ascii_letter)])
            letter = count[offsets[1:]] > count[offsets[:-1]]
            for k in np.flatnonzero(~letter & (np.diff(offsets) > 0)):
                letter[k] = has_letter(data[offsets[k] : offsets[k + 1]].tobytes())
            if net:
                lo = 0
                while lo < n:  # texts of about a megabyte together, a long one in parts
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
                    for b in range(int(offsets[lo]), max(int(offsets[hi]), int(offsets[lo]) + 1), 1 << 20):
                        e = min(b + (1 << 20), int(offsets[hi])) if hi == lo + 1 else int(offsets[hi])
                        o = np.clip(offsets[lo : hi + 1], b, e) - b
                        x, row = windows_of(data[b:e], o)
                        lp = net.log_probs(x, tables)
                        for c in range(total.shape[1]):
                            total[lo:hi, c] += np.bincount(row, lp[:, c], hi - lo)
                            seen[lo:hi, c] += np.bincount(row, np.exp(lp[:, c]), hi - lo)
                        if hi > lo + 1:
                            break
                    lo = hi
            best = total.argmax(1)
            used = np.maximum(-(-np.diff(offsets) // WINDOW), 1)
            score = np.where(letter, seen[np.arange(n), best] / used, 0.0) if net else np.zeros(n)
            label = [net.labels[b] if net and ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "t"] + [pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1))],
                [c for c in batch.schema.names if c != "t"] + ["lang_pred", "score"],
            )

    source = docs.select(F.col(id).alias("k0"), *[F.col(c).alias(f"k{i + 1}") for i, c in enumerate(keep)], text_of(text).alias("t"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "t"]
    out = source.transform(in_arrow, run, ", ".join([*fields, "lang_pred string", "score double"]))
    return out.select(F.col("k0").alias(id), *[F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, divisible by 5; so are rows without id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def least_score(docs: DataFrame, net: ByteNet, id: str = "doc_id", text: str = "text", label: str = "lang", share: float = 0.005) -> float:
    """The score under which no label explains a text: midway between chance and the score
    that all but ``share`` of the labelled documents reach that were not learned from. All of these are judged;
    scores count in steps of 1 / SCORE_STEPS, so that the driver gets so many counts at most."""
    chance = 1 / len(net.labels)
    known = docs.filter(held_out(id) & F.col(label).isin(net.labels) & F.col(text).isNotNull() & F.col(id).isNotNull())
    scored = predict(known, net, id, text, (label,)).filter(F.col("lang_pred") == F.col(label))
    counts = scored.groupBy(F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect()
    if not counts or len(net.labels) < 2:
        return 0.0
    below = np.cumsum([r["n"] for r in counts])
    low = counts[int(np.searchsorted(below, int(share * (below[-1] - 1)), "right"))]["step"] / SCORE_STEPS
    return (chance + low) / 2
