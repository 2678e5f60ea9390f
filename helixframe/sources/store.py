"""A store of segments: topology and sequences apart, sorted by name, so that fetching some names reads few pages.

Both tables are Parquet, dealt out by ranges of the name and sorted in each file, with Bloom filters on the name and
page indexes. A few names become a filter that goes down to the files' statistics; many are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are looked up by a filter; more are joined.
FEW = 1000
WRITER = {"parquet.bloom.filter.enabled#name": "true", "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "1000"}


def write_store(segments: DataFrame, edges: DataFrame, path: str, **writer: str) -> None:
    """``segments (name, seq, ...)`` and ``edges (a, ea, b, eb, ...)`` below ``path``."""
    options = WRITER | writer
    for table, tag, key in ((segments.drop("seq"), "topology", "name"), (segments.select("name", "seq"), "sequences", "name"), (edges, "links", "a")):
        own = {k.replace("#name", f"#{key}"): v for k, v in options.items()}
        table.repartitionByRange(key).sortWithinPartitions(key).write.options(**own).parquet(f"{path}/{tag}")


def read_store(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{tag}")


def fetched(spark: SparkSession, path: str, names: DataFrame | list[str], tag: str = "sequences") -> DataFrame:
    """Rows of ``names (name)``; of the links those that leave a segment in it."""
    key = "a" if tag == "links" else "name"
    table = read_store(spark, path, tag)
    if isinstance(names, DataFrame):
        wanted = names.select("name").distinct()
        some = [r["name"] for r in wanted.limit(FEW + 1).collect()]
        if len(some) > FEW:
            return table.join(wanted.withColumnRenamed("name", key), key, "left_semi").select(*table.columns)
        names = some
    return table.where(F.col(key).isin(names))
