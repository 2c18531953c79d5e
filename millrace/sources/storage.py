"""Paths in whatever store Spark reads: what they stand for, whether they are there, what lies below them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where), store


def has_scheme(path: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:/", path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without is of the default file system, from here if that is local."""
    if not has_scheme(path):
        path = path if os.path.isabs(path) else os.path.abspath(path)
    return str(_hadoop(spark, path)[0].toString())


def resolved(spark: SparkSession, path: str) -> str:
    """What a path stands for where a file system only maps others (viewfs): that store's URI.
    Of a path that is not there yet the nearest folder above it is resolved."""
    where, store = _hadoop(spark, qualified(spark, path))
    rest = []
    while not store.exists(where) and where.getParent() is not None:
        rest.append(where.getName())
        where = where.getParent()
    found = "/".join([str(store.resolvePath(where).toString()).rstrip("/"), *reversed(rest)])
    return re.sub(r"^file:/+", "file:///", found)


def kind(spark: SparkSession, path: str) -> str | None:
    """file, folder, or None where there is nothing."""
    where, store = _hadoop(spark, qualified(spark, path))
    if not store.exists(where):
        return None
    return "folder" if store.getFileStatus(where).isDirectory() else "file"


def any_case(suffix: str) -> str:
    """A glob of names that end so, in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length, modified) of all files below a path with a suffix, in any case. Spark lists folders
    on the cluster where there are many, and reads no file. It passes over names that begin with a dot or
    an underscore. A file is listed as itself; what isn't there, a file of another suffix and a folder without
    such files are errors."""
    found = kind(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if found == "file" and not path.lower().endswith(suffix):
        raise ValueError(f"{path} is not a {suffix} file")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(suffix)).load(qualified(spark, path))
    if found == "folder" and not rows.select("path").limit(1).count():
        raise FileNotFoundError(f"no {suffix} files under {path}")
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))
