"""The driver's contract imports without a session, and pairs queries with SQL."""

import subprocess
import sys
from pathlib import Path


def test_import_without_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
