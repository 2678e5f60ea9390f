"""Assembly-graph operators on ``segments (seg, length, coverage)`` and ``edges (a, ea, b, eb)``.

Edges hold both directions of each link. All steps are equi-joins and grouped
aggregates on segment ends; sequences stay out of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """``seg, end, degree``."""
    return edges.groupBy(F.col("a").alias("seg"), F.col("ea").alias("end")).agg(F.count("*").alias("degree"))


def with_degrees(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments with ``left`` and ``right``, the degrees of their ends."""
    sides = edges.groupBy(F.col("a").alias("seg")).agg(F.count_if(F.col("ea") == 0).alias("left"), F.count_if(F.col("ea") == 1).alias("right"))
    return segments.join(sides, "seg", "left").na.fill(0, ["left", "right"])


def with_neighbours(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Edges with the coverage and length of b."""
    other = segments.select(F.col("seg").alias("b"), F.col("coverage").alias("b_cov"), F.col("length").alias("b_len"))
    return edges.join(other, "b")


def best_neighbours(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """``seg, end, best, best_cov``: per end the neighbour with the highest coverage, ties to the smaller segment."""
    best = F.min(F.struct((-F.col("b_cov")).alias("c"), "b", "eb"))
    return with_neighbours(edges, segments).groupBy(F.col("a").alias("seg"), F.col("ea").alias("end")).agg(best.alias("m")).select("seg", "end", F.col("m.b").alias("best"), (-F.col("m.c")).alias("best_cov"))


def links_kept(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both segments are in ``kept (seg)``."""
    ids = kept.select("seg")
    return edges.join(ids.withColumnRenamed("seg", "a"), "a", "left_semi").join(ids.withColumnRenamed("seg", "b"), "b", "left_semi").select(*edges.columns)


def links_removed(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that are not among ``removed``, in either direction."""
    both = removed.select("a", "ea", "b", "eb").union(removed.select("b", "eb", "a", "ea"))
    return edges.join(both, ["a", "ea", "b", "eb"], "left_anti").select(*edges.columns)


def links_once(edges: DataFrame) -> DataFrame:
    """Each link in one direction, the smaller segment end first."""
    return edges.where("a < b or (a = b and ea <= eb)")


def links_turned(edges: DataFrame) -> DataFrame:
    """Each link as ``a, ea, b, eb`` with its smaller end first, as often as it is there in either direction."""
    turned = F.expr("a > b or (a = b and ea > eb)")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return edges.select(pick("a", "b"), pick("ea", "eb"), pick("b", "a"), pick("eb", "ea"))


def steps(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Half-edges with ``a_length``, ``a_coverage``, ``b_length`` and ``b_coverage``; a segment counts as one base at least.

    A link meets its segments once and is turned round afterwards.
    """
    shape = lambda x: segments.select(F.col("seg").alias(x), F.greatest("length", F.lit(1)).alias(f"{x}_length"), F.col("coverage").alias(f"{x}_coverage"))
    once = links_once(edges).select("a", F.col("ea").cast("int").alias("ea"), "b", F.col("eb").cast("int").alias("eb")).join(shape("a"), "a").join(shape("b"), "b")
    names = [("a", "b"), ("ea", "eb"), ("b", "a"), ("eb", "ea"), ("a_length", "b_length"), ("a_coverage", "b_coverage"), ("b_length", "a_length"), ("b_coverage", "a_coverage")]
    there, back = F.struct(*(x for x, _ in names)), F.struct(*(F.col(y).alias(x) for x, y in names))
    return once.select(F.explode(F.when(F.expr("a = b and ea = eb"), F.array(there)).otherwise(F.array(there, back))).alias("x")).select("x.*")


def shaved(segments: DataFrame, edges: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Without segments of at most ``longest`` that aren't linked on both ends."""
    kept = with_degrees(segments, edges).where((F.col("length") > longest) | ((F.col("left") > 0) & (F.col("right") > 0))).select(*segments.columns)
    return kept, links_kept(edges, kept)


def bubbles(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """``seg, sibling``: one neighbour on each side, whose ends have two links each, the other one to the same sibling."""
    ends = edges.groupBy(F.col("a").alias("seg"), F.col("ea").alias("end")).agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.min("eb").alias("into"))
    return siblings(ends, ends.where("n = 1"))


def siblings(ends: DataFrame, single: DataFrame) -> DataFrame:
    """The bubbles of ``single``, of the rows of ``ends (seg, end, n, lo, hi, into)`` with one link: the only neighbour is both ``lo`` and ``hi``, and entered by ``into``."""
    at = single.select("seg", F.col("lo").alias("b"), F.col("into").alias("eb"))
    pair = ends.where("n = 2").select(F.col("seg").alias("b"), F.col("end").alias("eb"), "lo", "hi")
    near = at.join(pair, ["b", "eb"]).select("seg", F.when(F.col("lo") == F.col("seg"), F.col("hi")).otherwise(F.col("lo")).alias("sibling"))
    both = near.groupBy("seg").agg(F.count("*").alias("n"), F.min("sibling").alias("lo"), F.max("sibling").alias("hi"))
    return both.where("n = 2 and lo = hi and lo <> seg").select("seg", F.col("lo").alias("sibling"))


def trimmed(segments: DataFrame, edges: DataFrame, min_coverage: float, min_length: int) -> tuple[DataFrame, DataFrame]:
    """One pass of tip, coverage-1-bubble and weak-link cleaning; returns removed segments and detached edges.

    A segment open on a side goes if its coverage is under ``min_coverage`` and it
    is short or has coverage 1; else its links to neighbours of over twice its
    coverage are cut. A segment of coverage 1 in a bubble goes. A segment linked
    on both sides, all of whose neighbours have at least twice its coverage and
    another such link at the same end, loses its links.
    """
    shape = with_degrees(segments, edges)
    open_side = (F.col("left") == 0) | (F.col("right") == 0)
    weak = (F.col("coverage") < min_coverage) & ((F.col("length") < min_length) | (F.col("coverage") == 1))
    tips = shape.where(open_side & weak).select("seg")
    popped = segments.where("coverage = 1").join(bubbles(segments, edges), "seg").select("seg")
    removed = tips.union(popped).distinct()
    return removed, detached(segments, edges, min_coverage, min_length)


def detached(segments: DataFrame, edges: DataFrame, min_coverage: float, min_length: int) -> DataFrame:
    """The links that ``trimmed`` cuts, once each."""
    shape = with_degrees(segments, edges)
    open_side = (F.col("left") == 0) | (F.col("right") == 0)
    weak = (F.col("coverage") < min_coverage) & ((F.col("length") < min_length) | (F.col("coverage") == 1))
    near = with_neighbours(edges, segments)
    own = shape.select(F.col("seg").alias("a"), "coverage", (open_side & ~weak).alias("is_open"), (~open_side).alias("is_linked"))
    seen = near.join(own, "a")
    strong_open = seen.where(F.col("is_open") & (F.col("b_cov") > 2 * F.col("coverage"))).select("a", "ea", "b", "eb")
    # b's end: the best coverage there. A link's own segment can't have twice its own coverage, unless that is 0
    at_end = near.groupBy(F.col("a").alias("b"), F.col("ea").alias("eb")).agg(F.max("b_cov").alias("top"), F.count("*").alias("n_links"))
    linked = seen.where("is_linked").join(at_end, ["b", "eb"])
    rival = (F.col("top") >= 2 * F.col("coverage")) & ((F.col("coverage") > 0) | (F.col("n_links") > 1))
    covered = (F.col("b_cov") >= 2 * F.col("coverage")) & rival
    judged = linked.groupBy("a").agg(F.min(covered.cast("int")).alias("all_covered")).where("all_covered = 1").select("a")
    cut = edges.join(judged, "a", "left_semi").select("a", "ea", "b", "eb")
    both = strong_open.union(cut)
    return links_once(both.union(both.select("b", "eb", "a", "ea")).distinct())


def walk_coverage(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """``seg, coverage``: each step adds the part of the segment that the rest of its read can cover, at most 1.

    ``steps (read_id, idx, seg, fwd)``; a read is as long as its segments together.
    """
    order = Window.partitionBy("read_id").orderBy(F.desc("idx"))
    placed = steps.join(segments.select("seg", "length"), "seg").withColumn("rest", F.sum("length").over(order))
    share = F.least(F.lit(1.0), F.col("rest") / F.col("length"))
    return placed.groupBy("seg").agg(F.sum(share).alias("coverage"))
