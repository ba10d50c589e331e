import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://" + {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name.startswith("op") or name in ("pipeline", "memo_project", "event_fold", "best_fit_packing", "round_robin_hosts"):
        print("ROWS", name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Python workers of a session started elsewhere have no path to the package: its functions travel by value."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    found = [x.split()[1] for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(found) == 15
