"""Train and validation by a hash of the document id: no leak, no state, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the assignment.
BUCKETS, MULTIPLIER, MASK = 10_000, 2_654_435_761, 0xFFFFFFFF


def bucket(document_id: Column, seed: int = 42) -> Column:
    """0 to 9999 from the first 32 bits of a hex id, mixed with the seed."""
    head = F.conv(F.substring(document_id, 1, 8), 16, 10).cast("long")
    return head.bitwiseXOR(F.lit((seed * MULTIPLIER) & MASK)) % BUCKETS


def assign(document_id: Column, ratio: float, seed: int = 42) -> Column:
    """``val`` for a share of the documents, else ``train``."""
    if not 0 <= ratio < 1:
        raise ValueError(f"the validation ratio must be in [0, 1), not {ratio}")
    return F.when(bucket(document_id, seed) < int(ratio * BUCKETS), "val").otherwise("train") if ratio else F.lit("train")


def split(docs: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Adds split; neither side stays empty if one document can be moved.

    The counts and the least document of each side are one aggregate row, joined back by
    a broadcast: no window over all documents. Needs columns source and document_id. The
    documents are read twice: give a table that is written down, not a plan to run twice.
    """
    marked = docs.withColumn("split", assign(F.col("document_id"), ratio, seed))
    least = F.struct("source", "document_id")
    facts = marked.agg(
        F.count_if(F.col("split") == "train").alias("__n_train"),
        F.count_if(F.col("split") == "val").alias("__n_val"),
        F.min(F.when(F.col("split") == "train", least)).alias("__train"),
        F.min(F.when(F.col("split") == "val", least)).alias("__val"),
    )
    to_train = (F.col("__n_train") == 0) & (F.col("__n_val") > 0) & (least == F.col("__val"))
    to_val = F.lit(ratio > 0) & (F.col("__n_val") == 0) & (F.col("__n_train") >= 2) & (least == F.col("__train"))
    moved = F.when(to_train, "train").when(to_val, "val").otherwise(F.col("split"))
    return marked.crossJoin(F.broadcast(facts)).withColumn("split", moved).drop("__n_train", "__n_val", "__train", "__val")


def overlap(parts: DataFrame) -> DataFrame:
    """Document ids on both sides; must be empty."""
    ids = [parts.filter(F.col("split") == s).select("document_id") for s in ("train", "val")]
    return ids[0].intersect(ids[1])
