"""Python workers must not need this package on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from cobaltmill.session import get_session
from cobaltmill.catalog import QUERIES
spark = get_session("workers", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
for name in ("cosine_topk", "cosine_topk_batch"):
    assert QUERIES[name](spark, {sf!r}).count() > 0, name
"""


def test_queries_run_from_another_folder(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, sf=sf)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
