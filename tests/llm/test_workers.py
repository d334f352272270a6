"""Workers have no copy of the package: all queries of the problems run from a folder without it."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tests.oracle import session
import __spark_entry__ as e
s, q = session(), e.queries()
for n in ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_windows", "p9_found", "p10_found"]:
    q[n](s, {sf!r}).count()
    print("ran", n)
"""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, sf=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert r.stdout.count("ran ") == 10, r.stderr[-3000:]
