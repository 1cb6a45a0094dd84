"""Tasks must not need the library on their own path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as contract
from tickloom.session import local_session
spark = local_session(2)
for name in ("c4_html_elements", "b6_replay_jobs", "s3_read_log_pages"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
