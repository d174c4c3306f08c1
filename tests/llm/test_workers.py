"""Python workers must not need the package on their path: every query of the
training-data operators, from another directory and in other processes."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from tuneframe.llm import registry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
queries = E.queries()
for name in registry.QUERIES:
    print("ROWS", name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "ckpt")], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=1200)
    got = dict(line.split()[1:] for line in out.stdout.splitlines() if line.startswith("ROWS"))
    assert len(got) == 14 and all(int(n) > 0 for n in got.values()), (got, out.stderr[-3000:])
