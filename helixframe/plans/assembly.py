"""Composed plans: correction of reads, unitigs over an increasing list of k, cleaning, untangling, and inflation.

Where two steps of a read leave a gap, it is filled if exactly one walk over the
graph fits, else the read is cut. Lengths of merged segments are those of their sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, containment, contract, edit, graph, inflate, kernels, kmers, longmers, paths, untangle
from ..operators.loop import written
from ..sources.formats import read_gfa

Graph = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Parameters:
    """The public parameters, with the defaults of the command line they stand for."""

    order: int = 101
    compression: int = 20
    hpc: bool = True
    min_abundance: int = 5
    ks: tuple[int, ...] = (17, 21, 31, 61, 101, 191)
    single_genome: bool = False
    km: int = 31
    contiguity: bool = True
    longest_read: int = 20_000
    k_correct: int = 25
    min_walk_coverage: int = 5

    def __post_init__(self) -> None:
        if self.order % 2 == 0:  # an even order has no middle
            object.__setattr__(self, "order", self.order - 1)
        if list(self.ks) != sorted(set(self.ks)):
            raise ValueError("the list of k must increase")
        if any(k % 2 == 0 for k in (*self.ks, self.k_correct)):
            raise ValueError("k has to be odd")

    def least(self) -> int:
        """How often a k-mer has to occur: a single genome lets weak ones go early."""
        return self.min_abundance if self.single_genome else 2


def unitig_graph(reads: DataFrame, k: int, least: int) -> Graph:
    """Unitigs ``seg, seq, length, coverage`` and the half-edges between them, which overlap by k - 1."""
    return longmers.unitigs(reads, k, least)


def spelled_unitigs(reads: DataFrame, k: int, least: int) -> DataFrame:
    """``seg, seq, n_kmers, coverage``: unitigs with their sequence."""
    return unitig_graph(reads, k, least)[0].select("seg", "seq", (F.col("length") - k + 1).cast("long").alias("n_kmers"), "coverage")


def merged(g: Graph) -> Graph:
    """Unbranched chains as one segment each, with their sequences and lengths."""
    whole, links = contract.merged(*g)
    return written(whole.select("seg", "seq", F.length("seq").alias("length"), "coverage"), "merged"), written(links, "merged-links")


def cleaned(g: Graph, k: int, p: Parameters, extra: float) -> Graph:
    """Without bubbles, dead ends and over-covered pieces; parallel walks between long segments' ends popped; merged."""
    kept = paths.pop_and_shave(*g, p.min_abundance, 2 * k + 1, k, extra, p.contiguity, p.single_genome)
    g = merged((g[0].join(kept, "seg", "left_semi"), graph.links_kept(g[1], kept)))
    if not p.contiguity:
        return g
    return merged((g[0], graph.links_removed(g[1], paths.popped(*g, p.longest_read // p.compression))))


def correct_reads(reads: DataFrame, p: Parameters) -> DataFrame:
    """``read_id, seq``: reads as a cleaned unitig graph spells them, in pieces; reads without a hit go."""
    segments, edges = cleaned(unitig_graph(reads, p.k_correct, p.least()), p.k_correct, p, 0)
    walked = written(align.placed(reads, segments, edges, p.k_correct), "placed-reads")
    return written(align.corrected(walked, segments, edges).select(F.monotonically_increasing_id().alias("read_id"), "seq"), "corrected")


def iterative(reads: DataFrame, ks: tuple[int, ...], least: int, copies: int = 2) -> Graph:
    """The unitig graph of the last k: each round's long unitigs join the reads of the next one ``copies`` times."""
    source, g = reads.select("read_id", "seq"), None
    for i, k in enumerate(ks):
        g = unitig_graph(source, k, least)
        if i + 1 < len(ks):
            more = kmers.unitigs_for_next_k(g[0], ks[i + 1], copies)
            source = reads.select("read_id", "seq").union(more.select(F.xxhash64("name").alias("read_id"), "seq"))
    return g


def resolved(g: Graph, reads: DataFrame, k: int, p: Parameters) -> Graph:
    """The graph untangled by the walks of reads; what several neighbours share exclusively copied; weak tips gone."""
    segments, edges = g
    steps = written(align.placed(reads, segments, edges, k), "placed-reads")
    # a piece is a walk of its own
    names = written(steps.select("read_id", "piece").distinct().withColumn("walk", F.monotonically_increasing_id()), "pieces")
    steps = written(steps.join(names, ["read_id", "piece"]).select(F.col("walk").alias("read_id"), "idx", "seg", "fwd"), "steps")
    seen = graph.walk_coverage(steps, segments)
    segments = written(segments.drop("coverage").join(seen, "seg", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))), "covered")
    made, links = untangle.untangled(segments, edges, steps, p.min_walk_coverage)
    g = merged((made.drop("origin", "copy"), links))
    g = tuple(written(x, "copied") for x in edit.duplicated(*g, edit.shared_ends))
    if p.contiguity:
        kept = paths.pop_and_shave(*g, p.min_walk_coverage, 100, 31, 0, True, p.single_genome)
        g = g[0].join(kept, "seg", "left_semi"), graph.links_kept(g[1], kept)
    g = merged(g)
    removed, cut = graph.trimmed(*g, p.min_abundance, 2 * k)
    rest = g[0].join(removed, "seg", "left_anti")
    return merged((rest, graph.links_removed(graph.links_kept(g[1], rest), cut)))


def assembled(reads: DataFrame, p: Parameters) -> Graph:
    """The whole assembly of reads: corrected, unitigs over all k, cleaned, untangled, merged."""
    k = p.ks[-1]
    good = correct_reads(reads, p)
    # the last k's unitigs were counted twice more for each k before it
    return resolved(cleaned(iterative(good, p.ks, p.least()), k, p, 2), good, k, p)


def shrunk_assembly(reads: DataFrame, p: Parameters) -> Graph:
    """Reads shrunk, then assembled in shrunken space."""
    return assembled(written(kernels.reduced(reads, p.order, p.compression, p.hpc), "reduced"), p)


def assembly(reads: DataFrame, p: Parameters) -> Graph:
    """Reads shrunk, assembled, and inflated again: ``seg, seq, length, coverage`` and links with their overlaps in full sequence."""
    segments, edges = shrunk_assembly(reads, p)
    long = written(inflate.read_back(reads, segments.select("seg", "seq"), edges, p.order, p.compression, p.km, p.hpc).select("seg", "seq"), "inflated")
    found = inflate.overlaps(graph.links_once(edges), long, 150 * p.compression, 70 * p.compression)
    both = found.union(found.select("b", "eb", "a", "ea", "overlap")).distinct()
    return long.join(segments.select("seg", "coverage"), "seg").select("seg", "seq", F.length("seq").alias("length"), "coverage"), both


def missing_from(contigs: DataFrame, path: str) -> DataFrame:
    """The ``contigs (seg, seq)`` that no segment of a reference GFA holds, on either strand; segments without a sequence hold nothing."""
    references = read_gfa(contigs.sparkSession, path)[0].where("seq <> '*'").select("seq").distinct()
    numbered = written(references.select(F.monotonically_increasing_id().alias("read_id"), "seq"), "references")
    lost = containment.containment(contigs.select("seg", "seq"), numbered).where("n_in = 0")
    return contigs.join(lost.select("seg"), "seg", "left_semi")
