"""The driver's entry module without an optional library."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_a_missing_library_costs_only_the_operators_that_need_it():
    code = (
        "import sys; sys.modules['ahocorasick'] = None\n"
        "import __spark_entry__ as e\n"
        "from leasemill import registry\n"
        "assert set(e.queries()) == set(registry.queries()) and set(registry.queries()) <= set(e.oracle_sql())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
