"""Readers of documents: text files, JSON lines, Parquet, and a weighted manifest of them.

Each gives the core columns source, language, path, format, line, ord, text, prov and
error; a row has a text or an error, not both.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.storage import any_case, has_scheme, kind, listing, qualified

# Provenance columns that are kept where a Parquet file has them, and the
# optional keys of a JSON line.
PROVENANCE = ("id", "url", "dump", "title", "language", "language_score", "token_count", "score", "int_score")
JSON_KEYS = ("license", "url", "notes", "id")
FORMATS = {"txt": ".txt", "jsonl": ".jsonl", "parquet": ".parquet"}
#: Bytes of a scan, by its statistics, that are dealt out anew.
SPREAD_BYTES = 256 << 20
CORE = "source string, language string, path string, format string, line long, ord long, text string, prov map<string,string>, error string"


def list_files(path: str, suffix: str, spark: SparkSession | None = None) -> list[str]:
    """The files of a path with this suffix, sorted; what isn't there is an error. For folders of many
    files use ``storage.listing``, whose rows stay on the cluster."""
    rows = listing((spark or SparkSession.builder.getOrCreate()), path, suffix).select("path").orderBy("path").collect()
    return [re.sub(r"^file:/+", "/", r["path"]) for r in rows]


def _load(spark: SparkSession, path: str, suffix: str, fmt: str, **options: str | bool) -> DataFrame:
    """All files below a path with this suffix. Spark lists them; the driver holds no list."""
    listing(spark, path, suffix)  # what isn't there is an error
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(suffix)).options(**options)
    return reader.load(qualified(spark, path))


def _core(df: DataFrame, source: str, language: str | None, fmt: str) -> DataFrame:
    """Orders and types the core columns; those that a format lacks are null."""
    df = df.withColumns({"source": F.lit(source), "language": F.lit(language).cast("string"), "format": F.lit(fmt)})
    out = []
    for field in CORE.split(", "):
        name, kind = field.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(out)


def read_txt(spark: SparkSession, path: str, source: str, language: str | None = None) -> DataFrame:
    """One document a file; bytes that aren't UTF-8 become U+FFFD."""
    raw = _load(spark, path, ".txt", "binaryFile")
    rows = raw.select(F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("path"), F.lit(0).alias("line"))
    return _core(rows.withColumn("ord", F.lit(0)), source, language, "txt")


def read_txt_strict(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), trimmed; empty files and bytes that aren't UTF-8 are errors."""
    raw = _load(spark, path, ".txt", "binaryFile")
    text = F.trim(F.validate_utf8(F.col("content").cast("string")))
    return raw.select("path", F.when(text == "", F.raise_error(F.concat(F.lit("empty document: "), "path")).cast("string")).otherwise(text).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines of text files."""
    return _load(spark, path, ".txt", "text").select(F.trim("value").alias("line")).filter("line <> ''")


def parse_json_lines(lines: DataFrame, text_field: str = "text") -> DataFrame:
    """(path, line, text, prov, error) of raw lines (path, line, value), judged by Python's
    json: malformed_json, not_object, missing_field, non_string_text. Blank lines are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, line, value in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "value")), strict=True):
                where, text, prov, kind = f"{os.path.basename(path or '')}:{line}", None, {}, None
                try:
                    found = json.loads(value)
                except ValueError:
                    kind = "malformed_json"
                else:
                    if not isinstance(found, dict):
                        kind = "not_object"
                    elif text_field not in found:
                        kind = "missing_field"
                    elif not isinstance(found[text_field], str):
                        kind = "non_string_text"
                    else:
                        text = found[text_field].encode("utf-8", "replace").decode()
                        prov = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k in JSON_KEYS if (v := found.get(k)) is not None}
                out.append((path, line, text, list(prov.items()), kind and f"{kind}:{where}"))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "line", "text", "prov", "error"])

    full = lines.filter(F.trim("value") != "").select("path", F.col("line").cast("long").alias("line"), "value")
    return full.mapInArrow(run, "path string, line long, text string, prov map<string,string>, error string")


def read_jsonl(spark: SparkSession, path: str, source: str, language: str | None = None, text_field: str = "text") -> DataFrame:
    """One document a line; lines are numbered with the blank ones."""
    whole = _load(spark, path, ".jsonl", "text", wholetext=True).select("_metadata.file_path", "value")
    lines = whole.select(F.col("file_path").alias("path"), F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("k", "value"))
    parsed = parse_json_lines(lines.withColumn("line", F.col("k") + 1), text_field)
    return _core(parsed.withColumn("ord", F.col("line")), source, language, "jsonl")


def classify_json(value: Column, text_field: str = "text") -> Column:
    """The same four errors as a native expression over VARIANT, for lines without trailing garbage."""
    v = F.try_parse_json(value)
    field = F.try_variant_get(v, f"$.{text_field}", "variant")
    return (
        F.when(v.isNull(), "malformed_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
        .when(field.isNull(), "missing_field").when(F.schema_of_variant(field) != "STRING", "non_string_text")
    )


def with_errors(df: DataFrame, text_field: str = "text") -> DataFrame:
    """Adds error to a table of documents: null_text, or non_string_text where the type is no string."""
    if text_field not in df.columns:
        raise ValueError(f"no column {text_field!r}; there are {', '.join(df.columns)}")
    kind = df.schema[text_field].dataType.simpleString()
    bad = F.lit("null_text" if kind == "string" else "non_string_text")
    wrong = F.col(text_field).isNull() if kind == "string" else F.lit(True)
    return df.withColumn("error", F.when(F.col(text_field).isNull(), "null_text").when(wrong, bad))


def read_parquet(spark: SparkSession, path: str, source: str, language: str | None = None, text_field: str = "text") -> DataFrame:
    """Rows of Parquet files: the text and what provenance columns there are, and no others."""
    found = _load(spark, path, ".parquet", "parquet")
    checked = with_errors(found, text_field)
    there = [c for c in PROVENANCE if c in found.columns]
    prov = F.map_filter(F.create_map(*[x for c in there for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if there else F.create_map()
    text = F.when(F.col("error").isNull(), F.col(text_field).cast("string"))
    rows = checked.select(text.alias("text"), prov.cast("map<string,string>").alias("prov"), F.concat_ws(":", "error", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("e"), "error", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("ord"))
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.col("e")))
    return _core(rows, source, language, "parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table that a scan cuts into fewer parts than there are cores, such as one small file
    of one row group, dealt to all cores. Tables of over ``SPREAD_BYTES`` are left as they are,
    however many cores there are: no shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    small = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    return scan.repartition(cores) if small and scan.rdd.getNumPartitions() < cores else scan


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names, from a footer alone."""
    return spark.read.parquet(path).columns


def read_source(spark: SparkSession, path: str, source: str, fmt: str, language: str | None = None, text_field: str = "text") -> DataFrame:
    """The reader of a format."""
    kind = fmt.lower()
    if kind == "txt":
        return read_txt(spark, path, source, language)
    if kind == "jsonl":
        return read_jsonl(spark, path, source, language, text_field)
    if kind == "parquet":
        return read_parquet(spark, path, source, language, text_field)
    raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")


def load_manifest(path: str) -> dict:
    """A manifest: an object with sources, each of them with name, path, format and a weight of at least 0."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not found.get("sources"):
        raise ValueError("a manifest needs a non-empty list of sources")
    for s in found["sources"]:
        lost = [k for k in ("name", "path", "format", "weight") if k not in s]
        if lost:
            raise ValueError(f"source {s.get('name', '?')!r} lacks {', '.join(lost)}")
        if float(s["weight"]) < 0:
            raise ValueError(f"source {s['name']!r} has a negative weight")
    return found


def resolve(path: str, manifest: str, spark: SparkSession | None = None) -> str:
    """An absolute path or one with a scheme as it is; else beside the manifest, else from here."""
    if os.path.isabs(path) or has_scheme(path):
        return path
    session = spark or SparkSession.builder.getOrCreate()
    beside = f"{manifest.rpartition('/')[0] or '.'}/{path}"
    for tried in (beside, path):
        if kind(session, tried):
            return tried if has_scheme(tried) else str(Path(tried).resolve())
    raise FileNotFoundError(f"{path}: neither {beside} nor {Path.cwd() / path}")


def read_manifest(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    """All sources of a manifest, in its order (src_idx)."""
    parts = []
    for k, s in enumerate(load_manifest(path)["sources"]):
        df = read_source(spark, resolve(s["path"], path, spark), s["name"], s["format"], s.get("language"), s.get("text_field", text_field))
        parts.append(df.withColumn("src_idx", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b), parts)
