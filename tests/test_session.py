"""Work folders, and code in Python workers."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

# A session that sets nothing and workers that cannot import the package.
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
from stateglass.plans import QUERIES
from stateglass.session import work_dir

spark = SparkSession.builder.master("local[2]").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first, second = work_dir(spark, "a"), work_dir(spark, "a")
assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
for name in ("x1_decode_payloads", "t2_buffer_processor"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    environment["SPARK_CONF_DIR"] = str(tmp_path)  # no defaults of this machine
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT],
        cwd=tmp_path,
        env=environment,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "x1_decode_payloads 2800" in done.stdout
    assert "t2_buffer_processor 200" in done.stdout
