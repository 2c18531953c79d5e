"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Every source is shuffled by a seeded hash and each of its rows gets a fractional rank,
(2 rank - 1) / (2 rows of the source). Sorted by it, the sources interleave in
proportion, so that any run of consecutive rows has the mixture of the whole. Equal
runs of that order are the shards: their counts are at most one apart.

Ranks come in two steps, so that a source with a third of all rows is no task's lot:
counts by hash bucket give each bucket its first rank, a row number within the bucket
the rest. Texts don't move: sizes and checksums are computed where they are read.

Defined results: a null source is a stratum of its own; a null text has size 1 and the
checksum of nothing; repeated rows are placed each; ties go by hash, id, checksum and
size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Rows that one task orders at once.
PER_BUCKET = 5_000


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, id: str = "doc_id", text: str = "text", stratum: str = "source", per_bucket: int = PER_BUCKET) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, under the law of equal counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    rows = rows.withColumn("h", F.substring(F.md5(F.concat_ws("|", F.lit(seed), "id", "crc", "size").cast("binary")), 1, 16))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    buckets = max(1, total // per_bucket)
    tie = ["h", "id", "crc", "size"]

    # the leading digits of the hash cut each source into even buckets, in the order of the hash
    rows = rows.withColumn("bucket", F.expr(f"cast(conv(substring(h, 1, 8), 16, 10) AS long) * {buckets} div {1 << 32}"))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    own = Window.partitionBy("stratum")
    known = counts.select("stratum", "bucket", F.sum("n").over(own).alias("of"), (F.sum("n").over(own.orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*tie))
    ranked = rows.withColumn("nth", nth).join(known, ["stratum", "bucket"])
    fraction = (2 * (F.col("before") + F.col("nth")) - 1).cast("double") / (2 * F.col("of")).cast("double")
    ranked = materialize(ranked.select("id", "size", "crc", "h", "stratum", fraction.alias("fraction")), "shard-ranks")

    ranked = ranked.withColumn("run", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    runs = ranked.groupBy("run").agg(F.count("*").alias("n"))  # a row for each 5,000 documents
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("fraction", "stratum", *tie))
    placed = ranked.withColumn("nth", nth).join(runs, "run").withColumn("place", F.col("first") + F.col("nth") - 1)
    return placed.withColumn("shard", F.expr(f"cast(place * {shards} div {max(total, 1)} as int)")).select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard",
        F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id: str = "doc_id") -> None:
    """The documents as one folder a shard, its files in the order of their slots. Ids must be unique."""
    joined = docs.join(placed.select(id, "shard", "slot"), id)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def oracle(shards: int = 16, seed: int = 17) -> str:
    """The result of op9 in DuckDB; the checksum is computed byte by byte from its rule."""
    polynomial, ones = 0xEDB88320, 0xFFFFFFFF
    entry = "i"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}::BIGINT) ELSE c >> 1 END)[1]"
    byte = "(strpos('0123456789ABCDEF', h[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * k + 2]) - 1"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: {entry}) AS t),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, size, list_prepend({ones}::BIGINT, list_transform(range(len(h) // 2), lambda k: ({byte})::BIGINT)) AS b FROM d),
c AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, size::BIGINT AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), {ones}::BIGINT) AS crc FROM b, t),
h AS (SELECT *, substr(md5(concat_ws('|', {seed}, doc_id, crc, size)), 1, 16) AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, crc, size) AS nth, count(*) OVER (PARTITION BY stratum) AS n FROM h),
f AS (SELECT *, (2 * nth - 1)::DOUBLE / (2 * n)::DOUBLE AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, crc, size) - 1 AS place, count(*) OVER () AS total FROM f)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (place * {shards} // total)::INTEGER AS shard,
       (place - ((place * {shards} // total) * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
