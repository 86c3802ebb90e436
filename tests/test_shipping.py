"""Functions must reach executors that cannot import the package."""

import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)
NAMES = ("sanitize_text", "injection_by_category", "rate_limit", "alert_cooldown", "entity_spans", "dictionary_entities",
         "vector_anomalies", "similar_documents", "similar_documents_join", "conversation_drift", "chunk_classifier", "stream_context", "history_drift")
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
assert entry.entry(spark).count() > 5
for name in {NAMES!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect(), name
print("all shipped")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all shipped" in done.stdout, done.stderr[-2000:]
