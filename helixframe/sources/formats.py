"""Sources and sinks: FASTA, FASTQ, GFA, GAF, unitig FASTA, FASTG.

All read through Spark's text source, so remote paths, gzip and splits are
Spark's business (gzip files don't split: they are dealt out again).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators.loop import numbered
from ..session import prepare

TAGS = "DP|dp|km|rc"


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """``rec``: records that begin with ``mark`` at the start of a line; the first one keeps its mark in the file."""
    rows = spark.read.option("lineSep", "\n" + mark).text(path).select(F.regexp_replace("value", f"^{mark}", "").alias("rec"))
    rows = rows.where(F.trim("rec") != "")
    return rows.repartition(max(2, spark.sparkContext.defaultParallelism)) if path.endswith(".gz") else rows


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``; sequences may span lines."""
    lines = F.split("rec", "\r?\n")
    return _records(spark, path, ">").select(F.get(lines, F.lit(0)).alias("name"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))


def _fastq_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one split. ``kind`` 0: whole; 1: the split ends before its quality; 2: a quality that the split before lacks.

    Records were cut at line ends before ``@``. A quality may start with that too, and is then cut off as one
    more record of a single line.
    """
    names = ["kind", "name", "seq", "quality", "file", "start"]
    waiting = None
    for batch in batches:
        rows: list[tuple] = []
        for record, file, start in zip(batch["rec"].to_pylist(), batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
            lines = record.rstrip("\r\n").replace("\r\n", "\n").split("\n") if record.strip() else []
            if not lines:
                continue
            if waiting and (waiting[4], waiting[5]) != (file, start):
                rows.append(waiting)
                waiting = None
            if len(lines) == 1 and waiting:
                rows.append((0, waiting[1], waiting[2], "@" + lines[0], file, start))
                waiting = None
            elif len(lines) == 1:
                rows.append((2, None, None, "@" + lines[0], file, start))
            else:
                if waiting:  # a quality that isn't there
                    rows.append((0, *waiting[1:]))
                    waiting = None
                found = (lines[0].removeprefix("@"), lines[1], lines[3] if len(lines) > 3 else None, file, start)
                if len(lines) > 3:
                    rows.append((0, *found))
                else:
                    waiting = (1, *found)
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _FASTQ, strict=True)], names=names)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(waiting, _FASTQ, strict=True)], names=names)


_FASTQ = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, quality``, in as many tasks as the files have splits. An empty or missing quality is null.

    Records are four lines each. One whose quality lies beyond the end of its split finds it at the
    start of the next split of its file that has a record.
    """
    prepare(spark)
    rows = spark.read.option("lineSep", "\n@").text(path).select(F.col("value").alias("rec"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    parts = rows.mapInArrow(_fastq_part, "kind int, name string, seq string, quality string, file string, start long")
    # at most one loose quality, before all else, and one open record a split: each open one looks at what comes next
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    ends = parts.where("kind > 0").withColumn("rest", F.when(F.lead("kind").over(order) == 2, F.lead("quality").over(order)))
    closed = ends.where("kind = 1").select("name", "seq", F.col("rest").alias("quality"))
    found = parts.where("kind = 0").select("name", "seq", "quality").unionByName(closed)
    return found.repartition(max(2, spark.sparkContext.defaultParallelism)) if path.endswith(".gz") else found


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq`` by the file's suffix, ``.gz`` aside; names that start with ``false`` go."""
    plain = path.removesuffix(".gz")
    found = read_fastq(spark, path).select("name", "seq") if plain.endswith((".fastq", ".fq")) else read_fasta(spark, path)
    return found.where(~F.col("name").startswith("false"))


def read_gfa(spark: SparkSession, path: str, covered: bool = False, extra: float = 0) -> tuple[DataFrame, DataFrame]:
    """``(segments (name, seq, length, coverage), edges (a, ea, b, eb, overlap))`` keyed by names.

    Coverage is a DP, dp, km or rc tag, or KC or RC over the length, and loses ``extra``
    (down to 1). Without any it is 0, or an error when the graph has to be ``covered``.
    Links whose segments are unknown go; repeated links count once; both directions are kept.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.split("value", "\t").alias("f"))
    value = lambda names: F.regexp_extract("line", rf"\t(?:{names}):[fi]:([0-9.eE+-]+)", 1)
    number = lambda names: F.when(value(names) != "", value(names).cast("double"))
    seq = F.get("f", F.lit(2))
    listed = number("LN").cast("int")
    length = F.when(seq == "*", F.coalesce(listed, F.lit(0))).otherwise(F.length(seq))
    missing = F.raise_error(F.concat(F.lit("segment without coverage: "), F.get("f", F.lit(1)))).cast("double") if covered else F.lit(0.0)
    shown = F.coalesce(number(TAGS), number("KC|RC") / F.greatest(length, F.lit(1)), missing)
    shown = F.greatest(shown - extra, F.lit(1.0)) if extra else shown
    segments = lines.where(F.col("line").startswith("S\t")).select(F.get("f", F.lit(1)).alias("name"), seq.alias("seq"), length.alias("length"), shown.alias("coverage"))
    text = lambda i: F.get("f", F.lit(i))
    raw = lines.where(F.col("line").startswith("L\t")).select(text(1).alias("a"), F.when(text(2) == "+", 1).otherwise(0).alias("ea"), text(3).alias("b"), F.when(text(4) == "+", 0).otherwise(1).alias("eb"), F.regexp_extract(text(5), r"^(\d+)M$", 1).try_cast("int").alias("overlap"))
    names = segments.select("name")
    known = raw.join(names.withColumnRenamed("name", "a"), "a", "left_semi").join(names.withColumnRenamed("name", "b"), "b", "left_semi")
    both = known.select("a", "ea", "b", "eb", "overlap").union(known.select("b", "eb", "a", "ea", "overlap"))
    return segments, both.dropDuplicates(["a", "ea", "b", "eb"])


def gfa_lines(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """``rank, line``: S lines with coverage and length, then each link once; segments named ``delete_me`` go."""
    shown = segments.where("name <> 'delete_me'")
    s = shown.select(F.lit(0).alias("rank"), F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("DP:f:"), F.col("coverage").cast("string")), F.concat(F.lit("LN:i:"), F.col("length").cast("string"))).alias("line"))
    sign = lambda c, plus: F.when(F.col(c) == plus, "+").otherwise("-")
    cigar = F.coalesce(F.concat(F.col("overlap").cast("string"), F.lit("M")), F.lit("*"))
    once = edges.where("a < b or (a = b and ea <= eb)")
    links = once.select(F.lit(1).alias("rank"), F.concat_ws("\t", F.lit("L"), "a", sign("ea", 1), "b", sign("eb", 0), cigar).alias("line"))
    return s.union(links)


def write_gfa(segments: DataFrame, edges: DataFrame, path: str) -> None:
    """Segment lines before link lines, over as many files as the sort has partitions."""
    gfa_lines(segments, edges).orderBy("rank", "line").select("line").write.text(path)


def sorted_gfa(lines: DataFrame) -> DataFrame:
    """``line`` with segments first, then links; other lines go, order within is kept (``no`` is the line's number)."""
    rank = F.when(F.col("line").startswith("S\t"), 0).when(F.col("line").startswith("L\t"), 1)
    return lines.withColumn("rank", rank).where("rank is not null").orderBy("rank", "no").select("line")


def by_name(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments, with all columns, whose name is in ``names (name)``."""
    return segments.join(names.select("name").distinct(), "name", "left_semi")


def longest_first(segments: DataFrame, prefix: str | None = None) -> DataFrame:
    """Segments from the longest down, ties by name, with their ``place`` from 0; renamed ``<prefix><place>`` if there is one (``was`` is the old name)."""
    ordered = numbered(segments.orderBy(F.desc("length"), "name"))
    if prefix is None:
        return ordered
    return ordered.withColumn("was", F.col("name")).withColumn("name", F.concat(F.lit(prefix), F.col("place").cast("string")))


def merged_parts(parts: DataFrame) -> DataFrame:
    """``name, seq, length`` of ``parts (name, idx, seq, fwd, overlap)``: strand-correct, each but the first without its overlap with the one before."""
    text = F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    part = F.when(F.col("idx") == 0, text).otherwise(F.substr(text, F.coalesce("overlap", F.lit(0)) + 1))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("t")))), lambda x: x["t"])
    return parts.groupBy("name").agg(F.array_join(ordered, "").alias("seq")).withColumn("length", F.length("seq"))


def export_gfa(segments: DataFrame, edges: DataFrame, path: str, prefix: str | None = None) -> DataFrame:
    """Write segments longest first, then links, under new names if there is a prefix; returns old and new names."""
    ordered = longest_first(segments, prefix)
    names = ordered.select(F.col("was" if prefix else "name").alias("was"), "name")
    if prefix:
        left, right = names.toDF("a", "na"), names.toDF("b", "nb")
        other = [c for c in edges.columns if c not in ("a", "b")]
        edges = edges.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), *other)
    lines = gfa_lines(ordered, edges)
    place = ordered.select(F.col("name").alias("n"), "place")
    lines = lines.join(place, (F.col("rank") == 0) & (F.split_part("line", F.lit("\t"), F.lit(2)) == F.col("n")), "left")
    lines.orderBy("rank", "place", "line").select("line").write.text(path)
    return names


def export_fasta(segments: DataFrame, path: str) -> None:
    """``name, seq, length`` as FASTA, longest first."""
    write_fasta(longest_first(segments).orderBy("place"), path)


def write_fasta(segments: DataFrame, path: str) -> None:
    """``name, seq`` as FASTA."""
    segments.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def gfa_to_fasta(spark: SparkSession, gfa: str, fasta: str) -> None:
    write_fasta(read_gfa(spark, gfa)[0], fasta)


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, path``: columns 0 and 5."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("read_id"), F.get(f, F.lit(5)).alias("path"))


def gaf_lines(walks: DataFrame) -> DataFrame:
    """``line`` of ``walks (name, idx, read_length, path, path_length)``."""
    zero, n, p = F.lit("0"), F.col("read_length").cast("string"), F.col("path_length").cast("string")
    return walks.select(F.concat_ws("\t", F.concat_ws("_", "name", F.col("idx").cast("string")), n, zero, n, F.lit("+"), "path", p, zero, p, p, p, F.lit("255")).alias("line"))


def read_unitigs(spark: SparkSession, path: str, k: int, single_directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Segments and links of a unitig FASTA: header ``id LN:i: KC:i: km:f: L:±:id:±``."""
    records = _records(spark, path, ">")
    lines, head = F.split("rec", "\r?\n"), F.split(F.get(F.split("rec", "\r?\n"), F.lit(0)), " ")
    rows = records.select(F.get(head, F.lit(0)).alias("name"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"), head.alias("h"))
    km = F.get(F.filter("h", lambda x: x.startswith("km:f:")), F.lit(0))
    segments = rows.select("name", "seq", F.length("seq").alias("length"), F.coalesce(F.substring(km, 6, 40).cast("double"), F.lit(0.0)).alias("coverage"))
    parts = rows.select("name", F.explode(F.filter("h", lambda x: x.startswith("L:"))).alias("x")).select("name", F.split("x", ":").alias("l"))
    links = parts.select(F.col("name").alias("a"), F.when(F.get("l", F.lit(1)) == "+", 1).otherwise(0).alias("ea"), F.get("l", F.lit(2)).alias("b"), F.when(F.get("l", F.lit(3)) == "+", 0).otherwise(1).alias("eb"), F.lit(k - 1).alias("overlap"))
    if single_directed:
        links = links.where("a < b or (a = b and not (ea = 0 and eb = 1))")
    return segments, links.distinct()


def read_fastg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments and links of a FASTG: ``>name:nbr,nbr';``, an apostrophe marks the reverse strand."""
    records = _records(spark, path, ">")
    lines = F.split("rec", "\r?\n")
    rows = records.select(F.regexp_replace(F.get(lines, F.lit(0)), ";.*$", "").alias("head"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))
    name, to = F.split_part("head", F.lit(":"), F.lit(1)), F.split_part("head", F.lit(":"), F.lit(2))
    plain = lambda c: F.regexp_replace(c, "'$", "")
    segments = rows.where(~name.endswith("'")).select(name.alias("name"), "seq", F.length("seq").alias("length"), F.lit(0.0).alias("coverage"))
    each = rows.select(name.alias("n"), F.explode(F.split(to, ",")).alias("t")).where("t <> ''")
    links = each.select(plain(F.col("n")).alias("a"), F.when(F.col("n").endswith("'"), 0).otherwise(1).alias("ea"), plain(F.col("t")).alias("b"), F.when(F.col("t").endswith("'"), 1).otherwise(0).alias("eb"), F.lit(0).alias("overlap"))
    return segments, links.distinct()


def add_coverages(segments: DataFrame, coverages: DataFrame) -> DataFrame:
    """Segments with ``coverage`` from ``coverages (name, coverage)``, 0 where there is none."""
    new = coverages.select("name", F.col("coverage").alias("__new"))
    return segments.drop("coverage").join(new, "name", "left").withColumn("coverage", F.coalesce("__new", F.lit(0.0))).drop("__new")
