"""Connected components over a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release


#: Edges up to which a round is one task on one partition, without a shuffle: about 3 MB.
#: More are dealt out; the result is the same.
LOCAL_EDGES = 200_000


def _placed(edges: DataFrame, mark: tuple, local: int) -> DataFrame:
    return edges.coalesce(1) if mark[0] <= local else edges


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each neighbour v of u, with the least node m among u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node that has an edge: the root is the least node it reaches.

    ``edges`` has columns u and v of one comparable type. Each round hangs larger
    neighbours on the least node near them and halves the depth of what is left, so the
    rounds grow with the logarithm of the longest path. Minima are pre-aggregated
    before a shuffle; a node of many edges is split by the join, not gathered.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        here = _placed(now, mark, local)
        both = here.select("u", "v").withColumn("both", F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).select(F.inline("both"))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _least(large)  # here u > v: the smaller neighbours alone
        small = low.withColumn("both", F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).select(F.inline("both"))
        after = materialize(small.filter("u <> v").distinct(), "edges")
        release(now)
        now, (last, mark) = after, (mark, _mark(after))
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"edges have not settled after {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
