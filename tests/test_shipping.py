"""Workers import the package although they start in another folder without it."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.remove({root!r})
sys.path.insert(0, {root!r})
from fleetrisk.operators import calls
from fleetrisk.shipping import ship
ship(spark)
files = spark.createDataFrame([("r", "s", "a.ts", 10, "eval(req.body.x)")], "repo string, scan_id string, path string, size bigint, content string")
print("SITES", calls.call_sites(files).count())
"""


def test_ship(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SITES 1" in out.stdout, out.stderr[-2000:]
