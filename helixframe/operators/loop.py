"""Fixpoint loops with short lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and there is one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for all that is written inside, deleted at the end: results must be read or saved elsewhere before."""
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{_RUN.get() or shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(schema).parquet(path)


def together(frames: list[DataFrame]) -> DataFrame:
    """Frames of one schema that ``written`` wrote, as one scan."""
    folders = sorted({f.rpartition("/")[0] for df in frames for f in df.inputFiles()})
    schema = frames[0].schema
    return frames[0].sparkSession.read.schema(schema).parquet(*folders) if folders else frames[0]


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(spark, folder)


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of a sorted frame with their number in the order, from 0.

    Rows are written down with their partition and their number in it; partitions
    in their order are a short table, whose running sum gives the first number of each.
    """
    kept = written(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    parts = kept.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return kept.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__n")).drop("__part", "__n", "__rows", "__start")
