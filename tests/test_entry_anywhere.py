"""The driver imports __spark_entry__ from elsewhere: Python workers must not
need the package on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
q = E.queries()
n = q["batch_infer"](spark, "/root/testdata/sf0.001").count()
m = E.entry(spark).count()
print("ROWS", n, m)
"""


def test_queries_with_python_udfs_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 34 34" in out.stdout, out.stderr[-2000:]
