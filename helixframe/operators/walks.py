"""Read walks over the graph: parsing, validation, support of neighbouring paths, consensus, bridges.

A path is written like ``>12<7``: segments in order, ``>`` forward, ``<``
reverse. Each such token starts with its own sign, so string prefixes that end
before a sign are exactly path prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from . import graph
from .loop import written

MIN_SUPPORT = 2


def token(seg: Column, fwd: Column) -> Column:
    return F.concat(F.when(fwd, ">").otherwise("<"), seg.cast("string"))


def path_strings(steps: DataFrame) -> DataFrame:
    """``read_id, path`` of ``steps (read_id, idx, seg, fwd)``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", token(F.col("seg"), F.col("fwd")).alias("t")))), lambda x: x["t"])
    return steps.groupBy("read_id").agg(F.array_join(ordered, "").alias("path"))


def parsed(paths: DataFrame) -> DataFrame:
    """Steps of ``paths (read_id, path)``."""
    tokens = F.regexp_extract_all("path", F.lit("([<>][^<>]+)"), 1)
    return paths.select("read_id", F.posexplode(tokens).alias("idx", "t")).select("read_id", "idx", F.substr(F.col("t"), F.lit(2)).cast("long").alias("seg"), F.col("t").startswith(">").alias("fwd"))


def flipped(path: Column) -> Column:
    """The path walked the other way."""
    tokens = F.regexp_extract_all(path, F.lit("([<>][^<>]+)"), 1)
    return F.array_join(F.reverse(F.transform(tokens, lambda t: F.concat(F.translate(F.substring(t, 1, 1), "<>", "><"), F.substr(t, F.lit(2))))), "")


def split_at_missing_links(steps: DataFrame, edges: DataFrame, other: tuple[str, ...] = ()) -> DataFrame:
    """Steps with ``piece``: walks are cut between steps that no edge joins; ``idx`` counts anew in each piece. ``other`` columns stay."""
    order = Window.partitionBy("read_id").orderBy("idx")
    before = steps.select("read_id", "idx", "seg", "fwd", *other, F.lag("seg").over(order).alias("a"), F.when(F.lag("fwd").over(order), 1).otherwise(0).alias("ea"), F.when(F.col("fwd"), 0).otherwise(1).alias("eb"))
    known = edges.select("a", "ea", F.col("b").alias("kb"), F.col("eb").alias("keb"), F.lit(True).alias("linked"))
    joined = before.join(known.distinct(), (before["a"] == known["a"]) & (before["ea"] == known["ea"]) & (before["seg"] == F.col("kb")) & (before["eb"] == F.col("keb")), "left")
    cut = F.when(before["a"].isNotNull() & F.col("linked").isNull(), 1).otherwise(0)
    pieces = joined.select("read_id", "idx", "seg", "fwd", *other, F.sum(cut).over(order).alias("piece"))
    inner = Window.partitionBy("read_id", "piece").orderBy("idx")
    return pieces.select("read_id", "piece", (F.row_number().over(inner) - 1).alias("idx"), "seg", "fwd", *other)


_TOKEN_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _named(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The names of path prefixes of ``low`` to ``high`` steps out of each step of a walk, both ways (or the ``open`` ones): a chain of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs, fwds = batch["segs"], batch["fwds"]
            seg, fwd = segs.flatten().to_numpy(), fwds.flatten().to_numpy(zero_copy_only=False)
            size = pa.compute.list_value_length(segs).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            if low:
                own = batch["open"].flatten()
                walk = np.repeat(np.arange(len(size)), pa.compute.list_value_length(batch["open"]).to_numpy(zero_copy_only=False))
                at, ahead, name = (own.field(c).to_numpy(zero_copy_only=False) for c in ("at", "ahead", "node"))
                at, name = at.astype(np.int64), name.astype(np.int64).view(np.uint64).copy()
            else:
                walk = np.tile(np.repeat(np.arange(len(size)), size), 2)
                at = np.arange(len(walk)) - np.repeat([0, len(seg)], len(seg)) - start[walk]
                ahead, name = np.repeat([True, False], len(seg)), np.zeros(len(walk), np.uint64)
            left = np.where(ahead, size[walk] - 1 - at, at)
            some = np.flatnonzero(left > low)
            walk, at, ahead, name, left = (x[some] for x in (walk, at, ahead, name, left))
            place, way = start[walk] + at, np.where(ahead, 1, -1)
            step = _mixed(seg.view(np.uint64))
            tokens = _mixed(step + (fwd.astype(np.uint64) << np.uint64(1))), _mixed(step + ((~fwd).astype(np.uint64) << np.uint64(1)))
            many = np.minimum(left, high) - low
            nodes = np.zeros((len(place), many.max(initial=0) + 1), np.uint64)
            nodes[:, 0] = name
            for d in range(low + 1, low + nodes.shape[1]):
                on = np.flatnonzero(left >= d)
                to = place[on] + way[on] * d
                name[on] = _mixed(name[on] * _TOKEN_MIX + np.where(ahead[on], tokens[0][to], tokens[1][to]))
                nodes[on, d - low] = name[on]
            flat = nodes[np.arange(nodes.shape[1]) <= many[:, None]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many + 1))), pa.int32()), pa.array(flat))
            columns = [pa.array(seg[place]), pa.array((fwd[place] == ahead).astype(np.int32)), batch["read_id"].take(pa.array(walk)), pa.array(at.astype(np.int32)), pa.array(ahead), pa.array(left.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["seg", "side", "read_id", "at", "ahead", "n", "nodes"])

    return run


#: Steps that the first level of a trie of walks takes; each later one takes four times as many.
DEPTH = 8
#: Walks out of a segment's side that one task may take together.
OFTEN = 10_000


class Beyond:
    """What walks hold beyond each side of each segment, outwards: a trie of paths, walked level by level.

    A prefix is named by a chain of hashes over its steps, so names take eight
    bytes whatever the depth; one witness, a place in a walk, stands for all that share it. A level names some
    more steps of the paths that are still shared. Once a path is on its own, all its further steps have support 1 and
    nothing against them, and it isn't followed: the work is a walk's length times the depth to which it is shared.
    Strings are spelled from witnesses, and only for what is returned.
    """

    def __init__(self, steps: DataFrame, often: int = OFTEN):
        prepare(steps.sparkSession)
        spark_walk = F.array_sort(F.collect_list(F.struct("idx", "seg", "fwd")))
        self.walks = written(steps.groupBy("read_id").agg(spark_walk.alias("w")).select("read_id", F.transform("w", lambda x: x["seg"]).alias("segs"), F.transform("w", lambda x: x["fwd"]).alias("fwds")), "walks")
        self.levels, low, high, source = [], 0, DEPTH, self.walks
        while True:
            named = source.mapInArrow(_named(low, high), "seg long, side int, read_id long, at int, ahead boolean, n int, nodes array<long>")
            last = F.element_at("nodes", -1)
            paths = written(self._counted(named, low, often), "paths")
            prefixes = paths.select("seg", "side", "witness", F.explode(F.filter("facts", lambda x: x["mine"])).alias("x")).select("seg", "side", "x.depth", "witness", "x.support", "x.against")
            self.levels.append((low, high, paths, prefixes))
            shared = paths.where((F.col("n") > high) & (F.element_at("facts", -1)["support"] > 1)).select("seg", "side", "path").distinct()
            if shared.isEmpty():
                break
            onward = named.where(F.col("n") > high).select("seg", "side", "read_id", "at", "ahead", last.alias("path")).join(shared, ["seg", "side", "path"], "left_semi")
            onward = written(onward.groupBy("read_id").agg(F.collect_list(F.struct("at", "ahead", F.col("path").alias("node"))).alias("open")), "open")
            source, low, high = self.walks.join(onward, "read_id"), high, 4 * high

    @staticmethod
    def _counted(named: DataFrame, low: int, often: int) -> DataFrame:
        """``seg, side, path, n, root, w, witness, facts``: a level's distinct paths, with ``support`` and ``against`` of each prefix; one path of those that share it has ``mine``.

        All that goes out of a segment's side meets in one shuffle. Where that are more than ``often`` walks, they are dealt by
        their first step, and only how many there are is told to all; deeper levels are dealt by what they go on from.
        """
        deal = F.element_at("nodes", 1)
        if not low:
            busy = written(named.groupBy("seg", "side").agg(F.count("*").alias("all")).where(F.col("all") > often), "busy")
            named = named.join(F.broadcast(busy), ["seg", "side"], "left")
            deal = F.when(F.col("all").isNotNull(), F.element_at("nodes", 2)).otherwise(0)
        else:
            named = named.withColumn("all", F.lit(None).cast("long"))
        key = ["seg", "side", "deal"]
        dealt = named.select("seg", "side", deal.alias("deal"), "n", "read_id", "at", "nodes", "all").repartition(*key)
        # of a path that many walks hold one row with their number
        held = dealt.groupBy(*key, "n", F.element_at("nodes", -1).alias("path")).agg(F.count("*").alias("w"), F.min(F.struct("read_id", "at", "nodes")).alias("x"), F.max("all").alias("all"))
        pairs = F.arrays_zip(F.slice("x.nodes", F.lit(2), F.size("x.nodes") - 1).alias("node"), F.slice("x.nodes", F.lit(1), F.size("x.nodes") - 1).alias("parent"))
        each = held.select(*key, "n", "path", "w", "all", F.struct("x.read_id", "x.at").alias("witness"), F.element_at("x.nodes", 1).alias("root"), F.posexplode(pairs).alias("d", "x")).select(*key, "n", "path", "w", "all", "witness", "root", (F.col("d") + low + 1).alias("depth"), "x.node", "x.parent")
        same = Window.partitionBy(*key, "depth", "parent", "node")
        own = F.struct("n", "path")
        each = each.withColumn("support", F.sum("w").over(same)).withColumn("mine", own == F.min(own).over(same)).withColumn("total", F.sum("w").over(Window.partitionBy(*key, "depth", "parent")))
        total = F.when((F.col("depth") == 1) & F.col("all").isNotNull(), F.col("all")).otherwise(F.col("total"))
        fact = F.struct("depth", "support", (total - F.col("support")).alias("against"), "mine")
        return each.groupBy(*key, "n", "path").agg(F.first("root").alias("root"), F.first("w").alias("w"), F.first("witness").alias("witness"), F.array_sort(F.collect_list(fact)).alias("facts")).drop("deal")

    def _leaves(self, level: int, rows: DataFrame) -> DataFrame:
        """Rows (``n, facts``) of a level's paths that end there, or are on their own from its last step on."""
        return rows.where((F.col("n") <= self.levels[level][1]) | (F.element_at("facts", -1)["support"] == 1))

    def known(self) -> DataFrame:
        """``seg, side, depth, witness, support, against`` of every prefix, also of those that one walk alone holds."""
        out = None
        for k, (_, high, paths, held) in enumerate(self.levels):
            tails = self._leaves(k, paths.where(F.col("n") > high)).select("seg", "side", F.explode(F.sequence(F.lit(high + 1), F.col("n"))).alias("depth"), "witness", F.lit(1).cast("long").alias("support"), F.lit(0).cast("long").alias("against"))
            both = held.unionByName(tails)
            out = both if out is None else out.unionByName(both)
        return out

    def spelled(self, rows: DataFrame) -> DataFrame:
        """``rows (side, depth, witness)`` with ``path``, the first ``depth`` steps beyond the witness's place."""
        own = self.walks.select(F.col("read_id").alias("__read"), "segs", "fwds")
        at, depth = F.col("witness.at"), F.col("depth")
        joined = rows.join(own, F.col("witness.read_id") == F.col("__read"))
        ahead = (F.get("fwds", at).cast("int") == F.col("side"))
        pairs = F.arrays_zip(F.col("segs").alias("s"), F.col("fwds").alias("f"))
        out = F.transform(F.slice(pairs, at + 2, depth), lambda x: token(x["s"], x["f"]))
        back = F.transform(F.reverse(F.slice(pairs, at - depth + 1, depth)), lambda x: token(x["s"], ~x["f"]))
        return joined.withColumn("path", F.array_join(F.when(ahead, out).otherwise(back), "")).drop("__read", "segs", "fwds")

    def judged(self, ok: Callable[[Column, Column], Column]) -> DataFrame:
        """Each distinct path: ``good``, how many of its first steps are ok one after another, ``backed``, how many have support over 1; ``top``, whether no other goes on from it."""
        out = state = None
        for k, (_, high, paths, _) in enumerate(self.levels):
            depths = lambda keep: F.transform(F.filter("facts", keep), lambda x: x["depth"])
            found = paths.withColumn("bad", F.array_min(depths(lambda x: ~ok(x["support"], x["against"])))).withColumn("backed", F.array_max(depths(lambda x: x["support"] > 1)))
            if state is not None:
                found = found.join(state, ["seg", "side", "root"]).withColumn("bad", F.coalesce("bad_before", "bad")).withColumn("backed", F.coalesce("backed", "backed_before")).drop("bad_before", "backed_before")
                found = written(found, "judged")
            # what one walk alone holds has support 1 and nothing against it
            tail = F.when((F.col("n") > high) & ~ok(F.lit(1), F.lit(0)), F.lit(high + 1))
            # more walks than end with a path's last step go on from there
            top = F.element_at("facts", -1)["support"] == F.col("w")
            ended = self._leaves(k, found).select("seg", "side", "path", "n", (F.coalesce("bad", tail, F.col("n") + 1) - 1).alias("good"), F.coalesce("backed", F.lit(0)).alias("backed"), "witness", top.alias("top"))
            out = ended if out is None else out.unionByName(ended)
            state = found.where(F.col("n") > high).groupBy("seg", "side", F.col("path").alias("root")).agg(F.min("bad").alias("bad_before"), F.max("backed").alias("backed_before"))
        return out


def prefix_support(steps: DataFrame) -> DataFrame:
    """``seg, side, prefix, depth, support, against`` of every path prefix beyond a segment's side.

    ``against`` counts walks that agree up to the step before and then go elsewhere.
    """
    beyond = Beyond(steps)
    return beyond.spelled(beyond.known()).select("seg", "side", F.col("path").alias("prefix"), "depth", "support", "against")


def maximal(steps: DataFrame) -> DataFrame:
    """``seg, side, path``: distinct paths beyond a side that aren't a prefix of a longer one."""
    beyond = Beyond(steps)
    tops = beyond.judged(lambda support, against: support > 0).where("top").select("seg", "side", F.col("n").alias("depth"), "witness")
    return beyond.spelled(tops).select("seg", "side", "path")


def strong(steps: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """``seg, side, path, depth``: the longest prefix all of whose steps have ``least`` support and are undisputed, or have over 4.

    Ties go to the smaller path.
    """
    beyond = Beyond(steps)
    judged = beyond.judged(lambda support, against: (support >= least) & ((against == 0) | (support > 4)))
    judged = judged.where("good > 0").select("seg", "side", F.col("good").alias("depth"), "witness")
    longest = judged.withColumn("most", F.max("depth").over(Window.partitionBy("seg", "side"))).where("depth = most").drop("most")
    return beyond.spelled(longest).groupBy("seg", "side", "depth").agg(F.min("path").alias("path")).select("seg", "side", "path", "depth")


def consensus(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """``seg, left_path, right_path, haploid``.

    A maximal path is consensual if at every step 0.2 (support - 1) > against - 1
    and against < 5. The longest one wins, ties to the smaller path; of it the
    steps with support over 1 are kept. A side without walks is consensual and
    empty. Haploid: both sides are.
    """
    beyond = Beyond(steps)
    judged = beyond.judged(lambda support, against: (0.2 * (support - 1) > against - 1) & (against < 5)).where("good = n and top")
    longest = judged.withColumn("most", F.max("n").over(Window.partitionBy("seg", "side"))).where("n = most").select("seg", "side", "backed", F.col("n").alias("depth"), "witness")
    winners = beyond.spelled(longest).groupBy("seg", "side").agg(F.min(F.struct("path", "backed")).alias("b"))
    tokens = F.slice(F.regexp_extract_all("b.path", F.lit("([<>][^<>]+)"), 1), F.lit(1), F.col("b.backed"))
    trimmed = winners.select("seg", "side", F.array_join(tokens, "").alias("kept"), F.lit(True).alias("consensual"))
    walked = beyond.levels[0][2].select("seg", "side").distinct()
    sides = walked.join(trimmed, ["seg", "side"], "left")
    wide = sides.groupBy("seg").agg(
        *(F.max(F.when(F.col("side") == s, F.coalesce("kept", F.lit("")))).alias(n) for s, n in ((0, "left_path"), (1, "right_path"))),
        F.count_if(F.col("consensual").isNull()).alias("open"),
    )
    return segments.select("seg").join(wide, "seg", "left").select("seg", F.coalesce("left_path", F.lit("")).alias("left_path"), F.coalesce("right_path", F.lit("")).alias("right_path"), (F.coalesce("open", F.lit(0)) == 0).alias("haploid"))


def bridges(agreed: DataFrame) -> DataFrame:
    """``seg, side, target, target_side, path``: from a haploid segment along its consensus to the first other haploid one.

    Kept where the partner's consensus leads back to the segment, and once: from
    the smaller (segment, side). The path ends with the partner.
    """
    out = agreed.where("haploid").select("seg", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_path").alias("path")), F.struct(F.lit(1).alias("side"), F.col("right_path").alias("path")))).alias("x")).select("seg", "x.side", F.regexp_extract_all("x.path", F.lit("([<>][^<>]+)"), 1).alias("tokens"))
    each = out.select("seg", "side", "tokens", F.posexplode("tokens").alias("i", "t")).select("seg", "side", "tokens", "i", F.substr(F.col("t"), F.lit(2)).cast("long").alias("other"), F.when(F.col("t").startswith(">"), 0).otherwise(1).alias("entered"))
    first = each.join(agreed.where("haploid").select(F.col("seg").alias("other")), "other", "left_semi").where("other <> seg").groupBy("seg", "side").agg(F.min(F.struct("i", "other", "entered", "tokens")).alias("f"))
    found = first.select("seg", "side", F.col("f.other").alias("target"), F.col("f.entered").alias("target_side"), F.array_join(F.slice(F.col("f.tokens"), F.lit(1), F.col("f.i") + 1), "").alias("path"))
    back = found.select(F.col("target").alias("seg"), F.col("target_side").alias("side"), F.col("seg").alias("target"), F.col("side").alias("target_side"))
    mutual = found.join(back, ["seg", "side", "target", "target_side"], "left_semi")
    return mutual.where("seg < target or (seg = target and side <= target_side)").select("seg", "side", "target", "target_side", "path")


def unrepresented(strong_walks: DataFrame, built: DataFrame) -> DataFrame:
    """Strong walks, with their segment, that no bridge holds in either direction; only of segments with one on each side.

    Candidates meet on the segment: a bridge can hold a walk only if it holds its segment.
    """
    sign = lambda side: F.when(side == 1, ">").otherwise("<")
    whole = strong_walks.withColumn("walk", F.concat(sign(F.col("side")), F.col("seg").cast("string"), "path"))
    line = built.select(F.concat(sign(F.col("side")), F.col("seg").cast("string"), "path").alias("line"))
    both = line.union(line.select(flipped(F.col("line")).alias("line")))
    tokens = F.transform(F.regexp_extract_all("line", F.lit("([<>][^<>]+)"), 1), lambda t: F.substr(t, F.lit(2)).cast("long"))
    keyed = both.select("line", F.explode(F.array_distinct(tokens)).alias("key"))
    held = whole.join(keyed, whole["seg"] == keyed["key"]).where(F.concat("line", F.lit(">")).contains(F.concat("walk", F.lit(">"))) | F.concat("line", F.lit(">")).contains(F.concat("walk", F.lit("<")))).select("seg", "side").distinct()
    rest = whole.join(held, ["seg", "side"], "left_anti")
    two = rest.groupBy("seg").agg(F.countDistinct("side").alias("n")).where("n = 2").select("seg")
    return rest.join(two, "seg", "left_semi").select("seg", "side", "path")


def minimum_coverage(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """``read_id, coverage``: the lowest coverage of the segments a walk passes."""
    return steps.join(segments.select("seg", "coverage"), "seg").groupBy("read_id").agg(F.min("coverage").alias("coverage"))


def counters(steps: DataFrame) -> DataFrame:
    """One row: ``n_walks``, and of these ``n_single``, which stay on one segment."""
    sizes = steps.groupBy("read_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_walks"), F.count_if(F.col("n") == 1).alias("n_single"))
