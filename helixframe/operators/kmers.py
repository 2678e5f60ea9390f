"""K-mer counting, lookup and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import unpacked
from . import kernels
from .loop import written
from .sieve import sieve


def counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """``kmer, n`` over packed canonical k-mers with at least ``least`` occurrences.

    Counted per batch, per task and after one shuffle of eight-byte keys, so a
    k-mer in a third of all reads arrives as one row a task.
    """
    found = kernels.packed_kmers(reads, k).groupBy("kmer").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least) if least > 1 else found


def named_counts(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """The same with k-mers as strings."""
    return counts(reads, k, least).select(unpacked(F.col("kmer"), k).alias("kmer"), "n")


def spectrum(reads: DataFrame, k: int) -> DataFrame:
    """How many distinct k-mers occur n times."""
    return counts(reads, k).groupBy("n").agg(F.count("*").alias("n_kmers"))


def contig_index(contigs: DataFrame, k: int, stride: int) -> DataFrame:
    """``kmer, seg, cpos``: one place of each k-mer at every ``stride``-th position of contigs (``seg, seq``).

    A k-mer on several places keeps the smallest segment and position.
    """
    places = kernels.kmer_places(contigs.select(F.col("seg").alias("read_id"), "seq"), k, stride)
    return places.groupBy(F.col("forward").alias("kmer")).agg(F.min(F.struct(F.col("read_id").alias("seg"), F.col("pos").alias("cpos"))).alias("p")).select("kmer", "p.seg", "p.cpos")


def contig_hits(reads: DataFrame, contigs: DataFrame, k: int, stride: int = 5) -> DataFrame:
    """``read_id, pos, seg, cpos, fwd``: the contig place of each read k-mer, the forward strand first.

    A sieve of the index's k-mers stands in the kernel, so about as many rows leave
    it as there are hits. K-mers over 31 bases are compared by a 64-bit hash.
    """
    index = written(contig_index(contigs, k, stride), "index")
    found = kernels.probes(reads, k, sieve(index.select(F.col("kmer").alias("key")))).join(index, "kmer")
    hits = found.groupBy("read_id", "pos").agg(F.max(F.struct(F.col("fwd").cast("boolean").alias("fwd"), "seg", "cpos")).alias("h"))
    return hits.select("read_id", "pos", "h.seg", "h.cpos", "h.fwd")


def needed(contigs: DataFrame, k: int, stride: int) -> DataFrame:
    """Distinct k-mers that reading contigs back needs: every ``stride``-th and the last of each contig."""
    shape = contigs.where(F.length("seq") >= k).select("seq", F.explode(F.array_union(F.sequence(F.lit(0), F.length("seq") - k, F.lit(stride)), F.array(F.length("seq") - k))).alias("at"))
    return shape.select(F.substr("seq", F.col("at") + 1, F.lit(k)).alias("kmer")).distinct()


def semi_join(reads: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``read_id, pos, kmer`` of read k-mers whose either strand is wanted (strings)."""
    keys = kernels.kmer_places(wanted.select(F.lit(0).cast("long").alias("read_id"), F.col("kmer").alias("seq")), k)
    both = written(keys.select("forward").union(keys.select("reverse")).distinct().withColumnRenamed("forward", "kmer"), "wanted")
    found = kernels.probes(reads, k, sieve(both.select(F.col("kmer").alias("key")))).where("fwd = 1")
    return found.join(both, "kmer", "left_semi").select("read_id", "pos", unpacked(F.col("kmer"), k).alias("kmer"))


def majority(sightings: DataFrame, confirm: int = 4) -> DataFrame:
    """Per key the sequence that is first seen ``confirm`` times, else the one that is seen first.

    ``sightings (key, seq, ord)``, where ord is a total order of sightings. A
    sequence's ``confirm``-th sighting is found among its smallest ords, so one
    grouped pass with bounded state and one more over distinct sequences do.
    """
    nth = Window.partitionBy("key", "seq").orderBy("ord")
    ranked = sightings.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= confirm)
    each = ranked.groupBy("key", "seq").agg(F.min("ord").alias("first"), F.min(F.when(F.col("nth") == confirm, F.col("ord"))).alias("confirmed"))
    best = F.min(F.struct(F.col("confirmed").isNull().alias("open"), F.coalesce("confirmed", "first").alias("ord"), "seq"))
    return each.groupBy("key").agg(best.alias("b")).select("key", F.col("b.seq").alias("seq"), (~F.col("b.open")).alias("confirmed"))


def unitigs_for_next_k(segments: DataFrame, k: int, copies: int) -> DataFrame:
    """Segments (``seg, seq``) of at least k bases, ``copies`` times under numbered names."""
    long = segments.where(F.length("seq") >= k)
    return long.select("seg", "seq", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).select(F.concat_ws("_", F.col("seg").cast("string"), F.col("copy").cast("string")).alias("name"), "seq")
