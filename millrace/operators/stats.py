"""Corpus statistics: lengths, percentiles, contents, scores, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx

# Fixed values of the scale estimate.
MODEL_PARAMETERS, TOKENS_PER_PARAMETER = 36_837_888, 20


def lengths(docs: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, sum, min, max and mean; the mean of nothing is 0."""
    return docs.groupBy(*(keys or [])).agg(
        F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"),
        F.min(value).cast("long").alias("least"), F.max(value).cast("long").alias("most"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
    )


def percentiles(docs: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """One row of percentiles by linear interpolation; ``exact=False`` uses a bounded sketch."""
    of = F.percentile if exact else F.percentile_approx
    return docs.agg(*[of(value, F.lit(p)).cast("double").alias(f"p{round(100 * p)}") for p in points])


def contents(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.agg(*[F.count_if(f(t)).alias(name) for name, f in (("hangul", tx.has_hangul), ("latin", tx.has_latin), ("digits", tx.has_digit), ("math", tx.has_math))])


def histogram(docs: DataFrame, key: str) -> DataFrame:
    """Counts of a key and their shares."""
    counted = docs.groupBy(key).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def bottom_sample(docs: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k documents of least seeded hash: uniform, and the same in whatever order rows come."""
    return docs.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(k)


def estimate(kept_chars: Column, kept_docs: Column, sample_chars: Column, sample_tokens: Column, sample_docs: Column) -> tuple[Column, Column]:
    """(characters per content token, estimated tokens with one end token a document)."""
    content = F.greatest(F.lit(0), sample_tokens - sample_docs)
    ok = (sample_chars > 0) & (content > 0) & (kept_docs > 0)
    per_token = F.when(ok, sample_chars / F.nullif(content, F.lit(0)))
    return per_token, F.when(ok, tx.rounded(F.try_divide(kept_chars, per_token) + kept_docs)).otherwise(F.lit(0))


def token_estimate(kept: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: the estimate from a sample with columns chars and tokens, and its range.

    The range comes from the tenth and ninetieth of the sample's ratios (the lower of the
    two nearest ranks), held within 15 % of the estimate; 10 % with under two ratios.
    """
    whole = kept.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("kc"), F.count("*").alias("kd"))
    facts = sample.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("sc"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("st"), F.count("*").alias("sd"))
    ratio = F.try_divide(F.col("chars"), F.greatest(F.lit(0), F.col("tokens") - 1))
    ratios = sample.select(ratio.alias("r")).filter("r > 0")
    sorted_ = ratios.agg(F.sort_array(F.collect_list("r")).alias("xs"))  # as large as the sample, which is bounded
    per_token, total = estimate(*map(F.col, ("kc", "kd", "sc", "st", "sd")))
    rows = whole.crossJoin(facts).crossJoin(sorted_).withColumns({"chars_per_token": per_token, "estimated": total})
    n = F.size("xs")
    at = lambda q: F.element_at("xs", (F.floor((n - 1) * F.lit(q)) + 1).cast("int"))
    rows = rows.withColumn("p10", F.when(n >= 2, at(0.10))).withColumn("p90", F.when(n >= 2, at(0.90)))
    low, high = (tx.rounded(F.col("kc") / F.col(p) + F.col("kd")) for p in ("p90", "p10"))
    floor, ceil = tx.rounded(F.col("estimated") * 0.85), tx.rounded(F.col("estimated") * 1.15)
    a, b = F.greatest(F.least(low, high), floor), F.least(F.greatest(low, high), ceil)
    none = F.col("chars_per_token").isNull()
    wide = n < 2
    lo = F.when(none, 0).when(wide, tx.rounded(F.col("estimated") * 0.90)).when(a > b, floor).otherwise(a)
    hi = F.when(none, 0).when(wide, tx.rounded(F.col("estimated") * 1.10)).when(a > b, ceil).otherwise(b)
    return rows.select("chars_per_token", "estimated", lo.cast("long").alias("low"), hi.cast("long").alias("high"))


def scale_estimate(totals: DataFrame) -> DataFrame:
    """Coverage of the tokens that a model needs. Columns: tokens, disk_bytes, files."""
    needed = F.lit(MODEL_PARAMETERS * TOKENS_PER_PARAMETER).cast("long")
    mb = F.col("disk_bytes") / 1e6
    rows = totals.withColumns({"needed": needed, "missing": F.greatest(F.lit(0), needed - F.col("tokens")), "tokens_per_mb": F.coalesce(F.try_divide(F.col("tokens").cast("double"), mb), F.lit(0.0))})
    infinite = F.lit(float("inf"))
    rows = rows.withColumn("extra_mb", F.when(F.col("tokens_per_mb") > 0, F.try_divide(F.col("missing").cast("double"), F.col("tokens_per_mb"))).otherwise(infinite))
    shard = mb / F.greatest(F.col("files"), F.lit(1))
    extra = F.when((shard > 0) & (F.col("extra_mb") < infinite), F.try_divide(F.col("extra_mb"), shard)).otherwise(infinite)
    return rows.withColumn("coverage", F.col("tokens") / F.col("needed")).withColumn("extra_shards", extra)
