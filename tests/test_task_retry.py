"""Tasks that fail and are retried (a lost executor) give the same results:
line numbers from scan positions and skew-safe numbering are recomputed
identically."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import json, os, sys
sys.path.insert(0, ROOT)
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F, types as T
from tuneframe.sources.files import read_lines
from tuneframe.operators import ordering as O

spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.files.maxPartitionBytes", "4096").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
d = os.path.join(WORK, "data")
os.makedirs(d, exist_ok=True)
with open(os.path.join(d, "a.jsonl"), "w") as fh:
    fh.write("".join(json.dumps({"k": i}) + ("\r\n" if i % 3 else "\n") for i in range(3000)))

@F.udf(T.BooleanType())
def fail_first_attempt(x):
    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 1:
        raise RuntimeError("simulated executor loss")
    return True

def lines():
    return read_lines(spark, d).select("line_no", "line")

clean = sorted(map(tuple, lines().collect()))
retried = sorted(map(tuple, lines().where(fail_first_attempt("line")).collect()))
df = spark.range(0, 20000, numPartitions=8).select((F.col("id") % 3 == 0).alias("g"), "id")
n_clean = sorted(map(tuple, O.number_rows(df, ["g"], ["id"], "rn").collect()))
n_retried = sorted(map(tuple, O.number_rows(df, ["g"], ["id"], "rn").where(fail_first_attempt("rn")).collect()))
print("SAME", clean == retried and len(clean) == 3000, n_clean == n_retried and len(n_clean) == 20000)
"""


def test_results_survive_task_retries(tmp_path):
    script = f"ROOT = {ROOT!r}\nWORK = {str(tmp_path)!r}\n" + SCRIPT
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "SAME True True" in out.stdout, out.stderr[-3000:]
