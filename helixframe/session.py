"""What a Spark session needs before Python workers can run this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Give freed memory back: workers live on between tasks, and what one stage needed must not stay with the next.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_MMAP_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep them small.

    On a cluster whose nodes don't hold it there, ship it with ``--py-files``;
    the extra path does no harm.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
    for key, value in LEAN.items():
        env.setdefault(key, value)
    return spark
