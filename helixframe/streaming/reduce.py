"""Sequence reduction as a stream: each read is reduced by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import dna
from ..operators import kernels
from ..operators.loop import dropped, shared_dir, written


def reduced_stream(source: DataFrame, order: int, compression: int, hpc: bool = True) -> DataFrame:
    """A streaming frame of reads (``read_id, seq``) as one of reduced reads."""
    return kernels.reduced(source, order, compression, hpc)


def reduce_folder(spark: SparkSession, folder: str, schema: str, order: int, compression: int) -> DataFrame:
    """Read document files as they come, reduce them, and return what has been written once all are through.

    The sink is a Parquet folder with a checkpoint, so each file counts once even if the query restarts.
    """
    import uuid

    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    reads = docs.select(F.col("doc_id").alias("read_id"), dna(F.col("text")).alias("seq"))
    query = reduced_stream(reads, order, compression).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + ".state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("read_id long, seq string").parquet(out)


def reduce_documents(spark: SparkSession, sf_dir: str, order: int, compression: int) -> DataFrame:
    """The documents table as a stream of files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    copy = written(docs, "stream-in")
    folder = copy.inputFiles()[0].rpartition("/")[0]
    out = reduce_folder(spark, folder, "doc_id long, text string", order, compression)
    dropped(copy)
    return out
