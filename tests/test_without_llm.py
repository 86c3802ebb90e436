"""The library without its optional subpackage: the rest imports and its queries are there."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as entry
names = list(entry.queries())
assert len(names) > 80 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= set(names)
print("imported")
"""


def test_copy_without_folders(tmp_path):
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(REPO, copy, ignore=lambda folder, names: [
            n for n in names if n in ("llm", ".git", "__pycache__", ".pytest_cache") or (n == "corpus_pipeline.py" and not keep_pipeline)])
        assert not (copy / "textguard" / "llm").exists()
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)
        assert "imported" in done.stdout, done.stderr[-2000:]
