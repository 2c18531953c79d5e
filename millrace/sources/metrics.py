"""Metrics as JSON lines, appended."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def append_record(path: str, record: dict) -> None:
    """Appends one record to a local file, a line of JSON; folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("a", encoding="utf-8") as out:
        out.write(json.dumps(record, ensure_ascii=False) + "\n")


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines in any store, as part files of their own."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
