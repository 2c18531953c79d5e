"""The driver's contract without the optional parts."""

import subprocess
import sys
from pathlib import Path

from millrace.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def test_core_queries_remain_where_optional_parts_cannot_be_imported():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(q := e.catalog.queries()), len(q)); print(sorted(e.oracle_sql()) == sorted(e.catalog.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert got.stdout.split() == ["True", str(len(catalog.queries())), "True"]
