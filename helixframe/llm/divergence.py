"""Audit of how sources differ in their words: exact divergences of term distributions, by dense term blocks.

Terms are letters (A-Z lower-cased, and everything outside ASCII). A language keeps the terms
that stand in at least ``least`` of its documents. Each group, a (language,
source) with documents, and each language as a whole gives each kept term the
whole number p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two distributions differ at a
term by floor((p - q)^2 / (p + q)).

1. Terms are counted in stretches of text through an integer dictionary, a row for each group and
   term of a stretch, and summed by a grouped aggregation with partial sums.
2. Kept terms are dealt into blocks by a hash, so many that a block's dense matrix of
   groups by terms has about ``CELLS`` cells. A block is a NumPy int64 tile: all pairs
   of its groups are compared by broadcasting, in slices of bounded size, and
   summed over the block's terms; each group's terms above the language are cut to the best ``top``.
3. Partial pair matrices are added up, the blocks' best terms merged by a ranking
   that keeps ``top`` a group in each task before the shuffle.

The terms of a group never meet in one task, only a block's do. The groups with their totals
are known to all tasks; the pairs asked for are the square of them, and over ``GROUPS`` of them are refused.
Long division by thousands keeps quotients exact while counts are below 9 * 10^15.

Defined results: null text has no terms, null language and source are the empty
text; a language without kept terms has pairs of value 0 and no terms; a
source alone in its language has no pairs; repeated rows count again; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, stretches, utf8, word_ids

#: A term, after lower-casing A-Z.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST = 10
TOP = 10
CELLS = 1 << 16
SLICE = 1 << 21
GROUPS = 100_000
STRETCH = 6_000_000

Totals = dict[str, tuple[int, list[str], list[int]]]


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(utf8(batch["text"]))
        kinds = pa.StructArray.from_arrays([batch["lang"], batch["source"]], names=["lang", "source"]).to_pylist()
        for part in stretches(texts, STRETCH):
            groups = {k: i for i, k in enumerate(dict.fromkeys((k["lang"], k["source"]) for k in kinds[part]))}
            group = np.array([groups[k["lang"], k["source"]] for k in kinds[part]], np.int64)
            ids, doc, vocabulary = word_ids([terms(t) for t in texts[part]])
            size = max(len(vocabulary), 1)
            key, n = np.unique(group[doc] * size + ids, return_counts=True)
            once = np.unique(doc * size + ids)
            docs = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
            names = list(groups)
            pick = lambda i: pa.array([k[i] for k in names], pa.string()).take(pa.array(key // size))  # noqa: E731,B023
            columns = [pick(0), pick(1), vocabulary.take(pa.array(key % size)).cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / whole) for counts up to ``whole``, exact in 64 bits."""
    q = count // whole
    rest = count - q * whole
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        q, rest = q * 1000 + digit, rest - digit * whole
    return q + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(totals: Totals, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(lang: str, part: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(value), pa.string())
        return pa.RecordBatch.from_arrays([same(lang), source, same(part), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        lang = block["lang"][0].as_py()
        kept, sources, sizes = totals[lang]
        place = {s: i for i, s in enumerate(sources)}
        found = block["term"].combine_chunks().dictionary_encode()
        row = np.array([place[s] for s in block["source"].to_pylist()], np.int64)
        names = found.dictionary.cast(pa.string())
        counts = np.zeros((len(sources), len(names)), np.int64)
        counts[row, found.indices.to_numpy()] = block["n"].to_numpy()
        p = shares(counts + 2, np.array(sizes, np.int64)[:, None] + 2 * kept)
        q = shares(counts.sum(0) + 2, np.array(sum(sizes) + 2 * kept))
        named = pa.array(sources, pa.string())
        # pairs leave in slices of rows of the matrix, so a task never holds it whole
        step = max(1, SLICE // max(p.size, 1))
        for a in range(0, len(sources) if len(sources) > 1 else 0, step):
            values = np.zeros((len(p[a : a + step]), len(sources)), np.int64)
            wide = max(1, SLICE // values.size)
            for t in range(0, p.shape[1], wide):
                values += apart(p[a : a + step, None, t : t + wide], p[None, :, t : t + wide]).sum(2)
            ones, others = np.divmod(np.arange(values.size), len(sources))
            differ = ones + a != others
            yield rows(lang, "pair", named.take(pa.array(ones[differ] + a)), named.take(pa.array(others[differ])), values.ravel()[differ])
        above = apart(p, q)
        # the best of a group, ties by bytes of the term
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(np.array(names.cast(pa.binary()).to_pylist(), object), kind="stable")] = np.arange(len(names))
        best_of, best = [], []
        for g in range(len(sources)):
            can = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            if len(can) > top:
                least = np.partition(above[g, can], len(can) - top)[len(can) - top]
                can = can[above[g, can] >= least]
                can = can[np.lexsort((rank[can], -above[g, can]))][:top]
            best_of += [g] * len(can)
            best += can.tolist()
        at = np.array(best_of, np.int64), np.array(best, np.int64)
        yield rows(lang, "term", named.take(pa.array(at[0])), names.take(pa.array(at[1])), above[at])

    return run


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distances to the other sources, and its ``top`` terms above the language."""
    small_batches(docs.sparkSession)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text_of("text"), text_of("lang"), text_of("source"))
    counted = docs.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term"), "kept-terms")
    known = materialize(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    groups = docs.select("lang", "source").distinct().join(known.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = materialize(groups.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["n", "kept"]), "groups")
    if groups.count() > GROUPS:
        raise ValueError(f"over {GROUPS} groups: their pairs can't be listed")
    totals: Totals = {}
    for r in groups.collect():
        _, sources, sizes = totals.setdefault(r["lang"], (r["kept"], [], []))
        sources.append(r["source"])
        sizes.append(r["n"])
    many = docs.sparkSession.createDataFrame([(lang, max(1, -(-n * len(sources) // cells))) for lang, (n, sources, _) in totals.items()], "lang string, blocks long")
    blocks = known.join(F.broadcast(many), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    tiles = materialize(blocks.groupBy("lang", "block").applyInArrow(_tile(totals, top), "lang string, source string, part string, item string, value long"), "tiles")
    sums = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    best = ranked(tiles.where("part = 'term'").select("lang", "source", "part", "item", "value")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(best)
