"""Sending this subpackage's functions to executors by value, and caches per worker."""

from __future__ import annotations

import sys
import types
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: Files that are sent to all workers (vocabularies) may have so many bytes.
MAX_FILE = 64 * 2**20


def ship(module: str) -> None:
    """Let functions of a module travel with the task, so that executors need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, shared by its tasks."""
    holder = sys.modules.setdefault("textguard_worker_cache", types.ModuleType("textguard_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def broadcast_file(spark: SparkSession, path: str):
    """A broadcast of the bytes of a small file on the driver."""
    if Path(path).stat().st_size > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


ship(__name__)
