"""Relations derived from the driver's tables, as DataFrames and as DuckDB CTEs.

Reads are whole documents with letters turned into bases. Walks are orders: a
line item is a step over a segment (part and a class of its supplier), its
status the orientation. Half-edges are consecutive steps and their mirrors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import BASES, dna, dna_with_breaks
from ..operators import kernels

CLASSES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq``. Texts are only dealt out anew where the scan has fewer splits than there are cores."""
    return kernels.dna_reads(spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq")))


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def broken_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq`` with an N for each full stop and line end."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("read_id"), dna_with_breaks(F.col("text")).alias("seq"))


def walk_steps(spark: SparkSession, sf_dir: str, seg: Column | None = None) -> DataFrame:
    """``read_id, idx, seg, fwd``; line numbers aren't unique in an order, so they are grouped."""
    seg = F.col("l_partkey") * CLASSES + F.col("l_suppkey") % CLASSES if seg is None else seg
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seg.alias("seg"), (F.col("l_linestatus") == "O").alias("fwd"))
    # one shuffle serves grouping and numbering: partial groups of an order's lines would save nothing
    lines = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("seg").alias("seg"), F.max("fwd").alias("fwd"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return lines.select(F.col("l_orderkey").alias("read_id"), (F.row_number().over(order) - 1).alias("idx"), "seg", "fwd")


def followed(steps: DataFrame) -> DataFrame:
    """Steps with the link ``ea, b, eb`` to the next one; b is null after the last."""
    order = Window.partitionBy("read_id").orderBy("idx")
    return steps.select("*", F.when(F.col("fwd"), 1).otherwise(0).alias("ea"), F.lead("seg").over(order).alias("b"), F.when(F.lead("fwd").over(order), 0).otherwise(1).alias("eb"))


def half_edges(steps: DataFrame) -> DataFrame:
    """``a, ea, b, eb``: both directions of each link once. End 0 is a segment's left, 1 its right."""
    linked = steps if "eb" in steps.columns else followed(steps)
    return mirrored(linked.where("b is not null").select(F.col("seg").alias("a"), "ea", "b", "eb"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Distinct links travel once, the smaller end first, and are turned round afterwards."""
    turned = F.expr("a > b or (a = b and ea > eb)")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    once = edges.select(pick("a", "b"), pick("ea", "eb"), pick("b", "a"), pick("eb", "ea")).distinct()
    there, back = F.struct("a", "ea", "b", "eb"), F.struct(F.col("b").alias("a"), F.col("eb").alias("ea"), F.col("a").alias("b"), F.col("ea").alias("eb"))
    return once.select(F.explode(F.when(F.expr("a = b and ea = eb"), F.array(there)).otherwise(F.array(there, back))).alias("x")).select("x.a", "x.ea", "x.b", "x.eb")


def dense_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over ten segments only, so that paths have much support."""
    return walk_steps(spark, sf_dir, F.col("l_suppkey") % 10)


def tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of a graph to be untangled: an order goes its customer class's way, odd orders from its end.

    Half of 60 classes have ends of their own and shared segments between them; the others pass shared ones only.
    """
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("read_id")).agg((F.min("o_custkey") % 60).alias("s"))
    s = F.col("s")
    way = F.when(s < 30, F.array(1000 + s, 2000 + s % 6, 3000 + s % 4, 4000 + s)).otherwise(F.array(2100 + s % 3, 2200 + s % 2, 2300 + s % 3))
    odd = F.col("read_id") % 2 == 1
    return orders.select("read_id", F.posexplode(F.when(odd, F.reverse(way)).otherwise(way)).alias("idx", "seg"), (~odd).alias("fwd"))


def visited(steps: DataFrame) -> DataFrame:
    """``seg, length, coverage`` of the segments on walks: 100 bases, and how often they are passed."""
    return steps.groupBy("seg").agg(F.lit(100).alias("length"), F.count("*").cast("double").alias("coverage"))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments and edges of a graph full of bubbles: a customer's orders of one priority are parallel ways between two ends."""
    orders = table(spark, sf_dir, "orders").select(((F.col("o_custkey") * 5 + F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 4).alias("s"), (F.col("o_orderkey") * 4 + 2).alias("o"), (10 + F.col("o_orderkey") % 40).cast("int").alias("length"), (F.floor(F.col("o_totalprice") / 1000) + 1).cast("double").alias("coverage"))
    orders = orders.groupBy("s", "o").agg(F.max("length").alias("length"), F.max("coverage").alias("coverage"))
    ends = orders.groupBy("s").agg(F.sum("coverage").alias("coverage")).select(F.explode(F.array(F.col("s"), F.col("s") + 1)).alias("seg"), F.lit(1000).alias("length"), "coverage")
    links = orders.select(F.col("s").alias("a"), F.lit(1).alias("ea"), F.col("o").alias("b"), F.lit(0).alias("eb")).union(orders.select("o", F.lit(1), F.col("s") + 1, F.lit(0)))
    return orders.select(F.col("o").alias("seg"), "length", "coverage").union(ends), mirrored(links)


def segments(spark: SparkSession, sf_dir: str, steps: DataFrame) -> DataFrame:
    """``seg, length, coverage``: length from the part's size, coverage the number of steps over it."""
    visits = steps.select("seg", F.floor(F.col("seg") / CLASSES).alias("p_partkey")).repartition("p_partkey").groupBy("p_partkey", "seg").agg(F.count("*").cast("double").alias("coverage"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).cast("int").alias("length"))
    return visits.join(part, "p_partkey").select("seg", "length", "coverage")


def segment_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg, seq``: a part's texts as bases."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("seg"), dna(F.concat("p_name", "p_type", "p_brand")).alias("seq"))


def chunk_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contigs and links of a graph that reads walk: pieces of 100 bases, 70 apart; equal ones of all reads are one contig."""
    n = F.floor((F.length("seq") - 31) / 70) + 1
    cut = reads(spark, sf_dir).where(F.length("seq") >= 31).select("read_id", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("j")).select("read_id", "j", F.substr("seq", (F.col("j") * 70 + 1).cast("int"), F.lit(100)).alias("t"))
    named = cut.groupBy("t").agg(F.min(F.col("read_id") * 100_000 + F.col("j")).alias("seg"))
    order = Window.partitionBy("read_id").orderBy("j")
    line = cut.join(named, "t").select("seg", F.lead("seg").over(order).alias("b")).where("b is not null")
    return named.select("seg", F.col("t").alias("seq")), mirrored(line.select(F.col("seg").alias("a"), F.lit(1).alias("ea"), "b", F.lit(0).alias("eb"))).withColumn("overlap", F.lit(30))


def cut_reads(whole: DataFrame, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """``seg, seq`` pieces of each read, ``size`` bases with ``overlap`` in common, and the links between neighbours."""
    step = size - overlap
    n = F.greatest(F.floor((F.length("seq") - overlap + step - 1) / step), F.lit(1))
    cut = whole.where(F.length("seq") > 0).select("read_id", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    seg = F.col("read_id") * 100_000 + F.col("j")
    pieces = cut.select(seg.alias("seg"), F.substr("seq", (F.col("j") * step + 1).cast("int"), F.lit(size)).alias("seq"))
    line = cut.where("j > 0").select((seg - 1).alias("a"), F.lit(1).alias("ea"), seg.alias("b"), F.lit(0).alias("eb"))
    return pieces, mirrored(line).withColumn("overlap", F.lit(overlap))


def expanded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg, seq`` of every segment that a walk visits: its part's."""
    visited = walk_steps(spark, sf_dir).select("seg").distinct().withColumn("part", F.floor(F.col("seg") / CLASSES))
    parts = segment_sequences(spark, sf_dir).withColumnRenamed("seg", "part")
    return visited.join(parts, "part").select("seg", "seq")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CYCLED = "".join(BASES[i % 4] for i in range(26))


def sql_dna(text: str) -> str:
    return f"regexp_replace(translate({text}, '{_LETTERS + _LETTERS.upper()}', '{_CYCLED * 2}'), '[^ACGT]', '', 'g')"


def sql_rc(seq: str) -> str:
    return f"reverse(translate(regexp_replace({seq}, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"


SQL_PIECES = f"""reads AS (SELECT doc_id * 1000000 + unnest(range(0, len(p))) AS read_id, unnest(p) AS seq FROM (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(text, '{_LETTERS + _LETTERS.upper()}.' || chr(10), '{_CYCLED * 2}NN'), '[^ACGTN]', '', 'g'), '[ACGT]+') AS p FROM documents))"""
SQL_READS = f"reads AS (SELECT doc_id AS read_id, {sql_dna('text')} AS seq FROM documents)"
SQL_CHUNKS = """cut AS (SELECT read_id, j, substr(seq, 70 * j + 1, 100) AS t FROM (SELECT read_id, seq, unnest(range(0, (length(seq) - 31) // 70 + 1)) AS j FROM reads WHERE length(seq) >= 31)),
named AS (SELECT t, min(read_id * 100000 + j) AS seg FROM cut GROUP BY t),
contigs AS (SELECT seg, t AS seq FROM named),
lines AS (SELECT seg AS a, lead(seg) OVER (PARTITION BY read_id ORDER BY j) AS b FROM cut JOIN named USING (t)),
half_edges AS (SELECT a, 1 AS ea, b, 0 AS eb FROM lines WHERE b IS NOT NULL UNION SELECT b, 0, a, 1 FROM lines WHERE b IS NOT NULL)"""
SQL_STEPS = f"""walk_steps AS (
  SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS idx, seg, fwd
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey * {CLASSES} + l_suppkey % {CLASSES}) AS seg, bool_or(l_linestatus = 'O') AS fwd FROM lineitem GROUP BY 1, 2))"""
SQL_EDGES = """following AS (
  SELECT seg AS a, CASE WHEN fwd THEN 1 ELSE 0 END AS ea, lead(seg) OVER w AS b, CASE WHEN lead(fwd) OVER w THEN 0 ELSE 1 END AS eb
  FROM walk_steps WINDOW w AS (PARTITION BY read_id ORDER BY idx)),
half_edges AS (SELECT a, ea, b, eb FROM following WHERE b IS NOT NULL UNION SELECT b, eb, a, ea FROM following WHERE b IS NOT NULL)"""
SQL_SEGMENTS = f"""segments AS (
  SELECT seg, CAST(p_size * 10 AS INTEGER) AS length, coverage
  FROM (SELECT seg, CAST(count(*) AS DOUBLE) AS coverage FROM walk_steps GROUP BY seg) JOIN part ON p_partkey = seg // {CLASSES})"""
SQL_DENSE = SQL_STEPS.replace(f"l_partkey * {CLASSES} + l_suppkey % {CLASSES}", "l_suppkey % 10")
SQL_ORDERS = """ways AS (
  SELECT s, o, max(length) AS length, max(coverage) AS coverage FROM (
    SELECT (o_custkey * 5 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 4 AS s, o_orderkey * 4 + 2 AS o, 10 + o_orderkey % 40 AS length, floor(o_totalprice / 1000) + 1 AS coverage FROM orders) GROUP BY s, o),
forward AS (SELECT s AS a, 1 AS ea, o AS b, 0 AS eb FROM ways UNION SELECT o, 1, s + 1, 0 FROM ways),
half_edges AS (SELECT * FROM forward UNION SELECT b, eb, a, ea FROM forward)"""
SQL_TOURS = """walk_steps AS (
  SELECT read_id, i - 1 AS idx, CASE WHEN read_id % 2 = 1 THEN way[len(way) + 1 - i] ELSE way[i] END AS seg, read_id % 2 = 0 AS fwd FROM (
    SELECT read_id, way, unnest(range(1, len(way) + 1)) AS i FROM (
      SELECT read_id, CASE WHEN s < 30 THEN [1000 + s, 2000 + s % 6, 3000 + s % 4, 4000 + s] ELSE [2100 + s % 3, 2200 + s % 2, 2300 + s % 3] END AS way
      FROM (SELECT o_orderkey AS read_id, min(o_custkey) % 60 AS s FROM orders GROUP BY 1))))"""
SQL_GRAPH = f"{SQL_STEPS}, {SQL_EDGES}, {SQL_SEGMENTS}"
SQL_SEQUENCES = f"segment_seq AS (SELECT p_partkey AS seg, {sql_dna('p_name || p_type || p_brand')} AS seq FROM part)"
