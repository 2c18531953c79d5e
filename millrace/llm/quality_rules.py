"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Statistics are computed over whole texts. On labelled documents (at most ``sample`` of
them, a documented bound) rules are grown one by one: thresholds are added to a
conjunction while they raise the information gain, conditions are pruned from its end
while that does not lower its worth on rows set aside, and the rows it covers are taken
out. What comes out is an ordered list of readable conditions, emitted as one Spark
CASE expression; documents that no rule covers are kept.

Defined results: a null text has no words; labels that are null are not learned from;
of several labels of one document each counts; without both classes of labels the list
is empty and only the base rule decides; repeated rows are judged each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, slices, small_batches, text_of, utf8
from millrace.llm.hashing import span_hashes, windows, words

# Fixed values of the base rule.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks")
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)
_UP = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LOW = (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:'\"()[]{}-_/\\@^~`+=", np.uint8))


def _sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of some texts."""
    n = len(offsets) - 1
    h, starts, ends = words(data, offsets, fold=False)
    at = np.searchsorted(starts, offsets)
    out = {"n_words": np.diff(at)}
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    ink = np.cumsum(inside[:-1]).astype(bool)
    out["word_chars"] = _sums(ink & _HEAD[data], offsets)
    for name, kind in (("n_symbols", _IS_SYMBOL), ("n_upper", _UP), ("n_lower", _LOW), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = _sums(kind[data], offsets)
    dup, repeat, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    feeds = np.flatnonzero(data == 0x0A)
    for k in range(n):
        lo, hi = offsets[k], offsets[k + 1]
        if at[k] == at[k + 1]:
            continue
        f = feeds[np.searchsorted(feeds, lo) : np.searchsorted(feeds, hi)]
        a, b = np.append(lo, f + 1), np.append(f, hi)
        inked = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b = a[inked], b[inked]
        lines[k] = len(a)
        if len(a) > 1:
            dup[k] = len(a) - len(np.unique(span_hashes(data[lo:hi], a - lo, b - lo)))
        g = windows(h[at[k] : at[k + 1]], WINDOW)
        if len(g) > 1:
            _, back, many = np.unique(g, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(many[back] > 1)
            if len(twice):
                cover = np.zeros(len(g) + WINDOW, np.int64)
                cover[twice] += 1
                np.subtract.at(cover, twice + WINDOW, 1)
                repeat[k] = int((np.cumsum(cover)[:-1] > 0).sum())
    return out | {"n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines}


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the statistics, base_failed) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            for lo, hi, d, o in slices(data, offsets):
                c = counts(d, o)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *[pa.array(c[k].astype(np.int64)) for k in COUNTS]], ["id", *COUNTS])

    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(F.col(id).alias("id"), text_of(text).alias("t")).transform(in_arrow, run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumnRenamed("id", id).withColumn("base_failed", failed)


#: What rules may test: ratios of the statistics, as SQL that pandas evaluates alike.
FEATURES = {
    "n_words": "n_words * 1.0",
    "chars_per_word": "word_chars * 1.0 / n_words",
    "symbol_ratio": "n_symbols * 1.0 / word_chars",
    "dup_line_ratio": "n_dup_lines * 1.0 / n_lines",
    "repeat_ratio": "n_repeat_words * 1.0 / n_words",
    "upper_ratio": "n_upper * 1.0 / word_chars",
    "digit_ratio": "n_digits * 1.0 / word_chars",
    "mark_ratio": "n_marks * 1.0 / word_chars",
    "words_per_line": "n_words * 1.0 / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Adds the threshold of the highest information gain, until none helps or no good row is left."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base = np.log2(p0 / (p0 + n0))
        best, gain = None, 1e-6
        for f in FEATURES:
            v = x[f].to_numpy()
            u = np.unique(v[inside])
            at = np.unique(np.searchsorted(u, np.quantile(v[inside], np.linspace(0, 1, cuts))))
            for t in (u[at[at < len(u) - 1]] + u[at[at < len(u) - 1] + 1]) / 2:  # midway between neighbours
                for above in (True, False):
                    hit = inside & ((v > t) if above else (v <= t))
                    p, n = bad[hit].sum(), (~bad[hit]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - base)) > gain:
                        best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def learn(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.97, least: int = 5, most_rules: int = 12, most_conditions: int = 4, cuts: int = 33, seed: int = 5) -> list[Rule]:
    """Sequential covering of the bad rows; a rule must reach ``precision`` on all rows that are left."""
    aside = np.random.default_rng(seed).random(len(x)) < 1 / 3
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and (left & bad & ~aside).sum() >= least:
        rule = _grow(x[left & ~aside], bad[left & ~aside], most_conditions, cuts)

        def worth(r: Rule) -> float:
            hit = _covers(r, x) & left & aside
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x) & left
        if not rule or (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = 20_000) -> list[Rule]:
    """Learns the list from at most ``sample`` labelled documents, the first by a hash of the id."""
    picked = labels.filter(F.col(quality).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(quality).alias("quality"))
    picked = picked.orderBy(F.xxhash64(F.lit("fit"), "id"), "id", "quality").limit(sample)
    known = docs.select(F.col(id).alias("id"), F.col(text).alias("t")).join(F.broadcast(picked.select("id").distinct()), "id", "left_semi")
    stats = statistics(known, "id", "t").filter(~F.col("base_failed")).dropDuplicates(["id"])
    rows = stats.join(F.broadcast(picked), "id").selectExpr("id", "quality", *[f"{sql} AS {name}_" for name, sql in FEATURES.items()])
    rows = rows.toPandas().rename(columns={f"{k}_": k for k in FEATURES}).sort_values(["id", "quality"], ignore_index=True)
    x, bad = rows[list(FEATURES)].astype(float), (rows["quality"] == 0).to_numpy()
    return learn(x, bad) if bad.any() and not bad.all() else []


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(F.expr(" AND ".join(c.sql() for c in rules[k])), F.lit(k)).otherwise(out)
    return out


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (which one rejects, if any) and kept."""
    rule = F.when(F.col("base_failed"), F.lit(None).cast("int")).otherwise(verdict(rules))
    return stats.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
