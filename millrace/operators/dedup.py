"""Exact dedup: of equal texts one stays, whichever source it comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx


def ranked(docs: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Adds rank: 1 for the first of equal texts by ``order``. Texts meet by their hash."""
    same = Window.partitionBy(tx.content_hash(F.col(text))).orderBy(*order)
    return docs.withColumn("rank", F.row_number().over(same))


def winners(docs: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """The documents whose ``key`` won, by pre-aggregated minima: a text that a third of
    all rows repeat meets one row of each task, not all of them. ``key`` must be unique."""
    best = docs.select(tx.content_hash(F.col(text)).alias("hash"), F.struct(*order, key).alias("place"))
    best = best.groupBy("hash").agg(F.min("place").alias("place")).select(F.col(f"place.{key}").alias(key))
    return docs.join(best, key, "left_semi")


def places(docs: DataFrame, hash: str, order: list[str], keep: list[str]) -> DataFrame:
    """(*order, *keep) of the first of equal texts, from a table without texts: a minimum by hash, put
    together in each task before rows meet. Whoever holds the texts joins them by place."""
    best = docs.groupBy(hash).agg(F.min(F.struct(*order, *[k for k in keep if k not in order])).alias("place"))
    return best.select("place.*")


def counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Seen, kept and duplicates by source, from all documents and those that stay."""
    seen = docs.groupBy("source").agg(F.count("*").alias("seen"))
    rows = seen.join(kept.groupBy("source").agg(F.count("*").alias("kept")), "source", "left").fillna(0, ["kept"])
    return rows.withColumn("duplicates", F.col("seen") - F.col("kept"))


def stats(ranked: DataFrame) -> DataFrame:
    """Seen, kept and duplicates by source; a duplicate counts where it was lost."""
    seen = ranked.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("rank") == 1).alias("kept"))
    return seen.withColumn("duplicates", F.col("seen") - F.col("kept"))


def totals(ranked: DataFrame) -> DataFrame:
    """The same with a row of totals, its source null."""
    seen = ranked.rollup("source").agg(F.count("*").alias("seen"), F.count_if(F.col("rank") == 1).alias("kept"))
    return seen.withColumn("duplicates", F.col("seen") - F.col("kept"))
