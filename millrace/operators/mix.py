"""Weighted mixing toward character budgets, with bounded oversampling.

The greedy fill has a closed form. With ``before`` the characters of all earlier
(pass, document) rows of a source, a row is taken iff before < target, or it is the very
first one. Prefix sums come in two steps: sums of blocks of each source, then running
sums within a block. So a source with a third of all rows is not one task's lot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalized_weights(weights: DataFrame) -> DataFrame:
    """Adds target_weight, the share of each source; a sum of 0 is an error."""
    total = weights.agg(F.sum("weight").alias("__sum"))
    share = F.when(F.col("__sum") > 0, F.col("weight") / F.col("__sum")).otherwise(F.raise_error(F.lit("the sum of source weights must be > 0")).cast("double"))
    return weights.crossJoin(F.broadcast(total)).withColumn("target_weight", share).drop("__sum")


def prefixed(docs: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Adds n (rank from 1), before (characters of earlier documents), pool (all of the source's characters)
    and docs_in_pool; order is document_id, then ord, then chars. Columns: source, document_id, ord, chars."""
    total = docs.count()
    blocks = max(1, total // block_rows)
    if blocks == 1:
        own = Window.partitionBy("source")
        run = own.orderBy("document_id", "ord", "chars")
        return docs.withColumns({"n": F.row_number().over(run), "before": F.sum("chars").over(run) - F.col("chars"), "pool": F.sum("chars").over(own), "docs_in_pool": F.count("*").over(own)})
    # ids are hashes, so their leading digits cut every source into even blocks
    cut = docs.withColumn("block", F.conv(F.substring("document_id", 1, 8), 16, 10).cast("long") * blocks / F.lit(1 << 32)).withColumn("block", F.floor("block"))
    sums = cut.groupBy("source", "block").agg(F.sum("chars").alias("c"), F.count("*").alias("k"))
    own = Window.partitionBy("source")
    sums = sums.select("source", "block", (F.sum("c").over(own.orderBy("block")) - F.col("c")).alias("c0"), (F.sum("k").over(own.orderBy("block")) - F.col("k")).alias("k0"), F.sum("c").over(own).alias("pool"), F.sum("k").over(own).alias("docs_in_pool"))
    run = Window.partitionBy("source", "block").orderBy("document_id", "ord", "chars")
    inner = cut.withColumns({"n": F.row_number().over(run), "before": F.sum("chars").over(run) - F.col("chars")})
    return inner.join(sums, ["source", "block"]).withColumns({"n": F.col("n") + F.col("k0"), "before": F.col("before") + F.col("c0")}).drop("block", "c0", "k0")


def mix(docs: DataFrame, weights: DataFrame, max_oversample: int = 3) -> DataFrame:
    """The chosen rows with pass (from 0), target_chars and target_weight. Sources without a weight are dropped."""
    shares = normalized_weights(weights).select("source", "target_weight")
    whole = docs.agg(F.greatest(F.sum("chars"), F.lit(1)).alias("__all"))
    targets = shares.crossJoin(F.broadcast(whole)).select("source", "target_weight", (F.col("target_weight") * F.col("__all")).alias("target_chars"))
    passes = max(max_oversample, 1)
    rows = prefixed(docs).join(F.broadcast(targets), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    before = F.col("before") + F.col("pass") * F.col("pool")
    return rows.filter((before < F.col("target_chars")) | ((F.col("pass") == 0) & (F.col("n") == 1)))


def stats(docs: DataFrame, weights: DataFrame, mixed: DataFrame) -> DataFrame:
    """A row for each weighted source, whether it has documents or not; ``unique_docs`` is all
    that the source has, taken or not. ``mixed`` is the result of ``mix``."""
    shares = normalized_weights(weights).select("source", "target_weight")
    whole = docs.agg(F.greatest(F.sum("chars"), F.lit(1)).alias("__all"))
    got = mixed.groupBy("source").agg(F.sum("chars").alias("actual_chars"), F.count("*").alias("docs"), F.max("docs_in_pool").alias("unique_docs"), F.max("pass").cast("long").alias("repeat_passes"))
    rows = shares.crossJoin(F.broadcast(whole)).join(got, "source", "left").fillna(0, ["actual_chars", "docs", "unique_docs", "repeat_passes"])
    sum_ = rows.agg(F.greatest(F.sum("actual_chars"), F.lit(1)).alias("__sum"))
    return rows.crossJoin(F.broadcast(sum_)).select(
        "source", "target_weight", F.floor(F.col("target_weight") * F.col("__all")).cast("long").alias("target_chars"),
        "actual_chars", "docs", "unique_docs", "repeat_passes", (F.col("actual_chars") / F.col("__sum")).alias("actual_char_ratio"),
    )
