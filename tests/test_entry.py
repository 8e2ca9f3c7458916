import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_log_queries_stand_alone():
    """Without what the training-data subpackage needs, the queries over logs are still there."""
    block = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", block], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    assert "timeline" in out[0].split() and "timeline" in out[1].split()
    assert not any(name.startswith("op") for name in out[0].split())
