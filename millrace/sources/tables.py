"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset in local
    mode, as in tests. On a cluster executors would not see it: there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        hadoop = spark.sparkContext.getCheckpointDir()
        found = hadoop if hadoop else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
        found = f"file://{_own_dir[0]}"
    return found


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a table through Hadoop, so that any store works."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            _drop(spark, path)
        except Exception:  # the session has ended: nothing is left to delete with
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: it cuts the lineage, and
    the loss of an executor costs at most the task in hand. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _paths(df: DataFrame) -> list[str]:
    """The materialized tables that a DataFrame reads."""
    files = df.inputFiles()[:1]
    return [path for _, path in _made if any(path.rsplit("/", 1)[1] in f for f in files)]


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        for path in _paths(df):
            _made[:] = [one for one in _made if one[1] != path]
            _drop(df.sparkSession, path)


def written_bytes(df: DataFrame) -> int:
    """Bytes of a materialized table as it lies in the shared folder."""
    spark = df.sparkSession
    total = 0
    for path in _paths(df):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total
