"""The corpus dataflow on a stream of files: the same column expressions as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import text as tx
from millrace.operators import quality, split
from millrace.operators.quality import FilterConfig


def read(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def funnel(docs: DataFrame, config: FilterConfig = FilterConfig(), ratio: float = 0.01, seed: int = 42, arrival: str | None = None, delay: str = "7 days") -> DataFrame:
    """Normalized, filtered, deduplicated by content, split. With an arrival time the state
    of the dedup is bounded by the watermark; without one it holds every hash for good."""
    rows = quality.kept(quality.classify(docs, config)).withColumn("content_hash", tx.content_hash(F.col("text")))
    if arrival:
        rows = rows.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["content_hash"])
    else:
        rows = rows.dropDuplicates(["content_hash"])
    rows = rows.withColumn("document_id", tx.document_id(F.col("source"), F.col("text")))
    return rows.withColumn("split", split.assign(F.col("document_id"), ratio, seed))


def event_counts(events: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; late rows are dropped after ``delay``."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
