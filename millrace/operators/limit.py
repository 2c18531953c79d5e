"""The first rows of files in their order, by a cut-off place: what rows hold is not sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.tokens import offsets


def cut_off(docs: DataFrame, n: int, file: list[str], place: str) -> Column | None:
    """Whether a row is among the first n, by the columns of its file and then by its place in it; None if all are.

    Rows are counted by file; running counts of the files tell the file where the n-th row lies, and
    that file's places alone are sorted for it."""
    if n <= 0:
        return F.lit(False)
    counts = docs.groupBy(*file).agg(F.count("*").alias("n"))
    at = offsets(counts, "n", file).filter((F.col("offset") < n) & (F.col("offset") + F.col("n") >= n)).first()
    if at is None:
        return None
    own = docs
    for c in file:
        own = own.filter(F.col(c) == F.lit(at[c]))
    last = own.select(place).orderBy(place).limit(n - at["offset"]).agg(F.max(place).alias("last")).first()["last"]
    here, edge = F.struct(*file, place), F.struct(*[F.lit(at[c]).alias(c) for c in file], F.lit(last).alias(place))
    return here <= edge


def first(docs: DataFrame, n: int, file: list[str], place: str) -> DataFrame:
    """The first n rows, filtered where they are read."""
    inside = cut_off(docs, n, file, place)
    return docs if inside is None else docs.filter(inside)
