"""Every query of this subpackage on executors that cannot import the package."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent.parent)
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
assert len(names) == 14, names
for name in names:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect(), name
print("all shipped")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert "all shipped" in done.stdout, done.stderr[-2000:]
