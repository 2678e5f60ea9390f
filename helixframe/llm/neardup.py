"""Near-duplicates by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct ``shingle``-word
shingles (lower-cased A-Z, words between ASCII white space; a shorter text is one
shingle); sizes and similarities are those of the sets of hashes, and two texts'
shingles would have to collide to change them. Each of ``BUCKETS`` registers keeps the minimum of the set under its
own permutation as a leading-zero count (6 bits) and ``MANTISSA`` mantissa bits,
so a register takes 2 bytes and keeps its meaning for small sets, where
splitting one permutation over buckets would leave most of them empty. Bands of
``ROWS`` compressed registers give the candidate buckets: two sets at the
threshold 0.8 miss all 32 bands with a chance of 5e-8.

What stands between candidates and an answer:

1. Equal sets are one class from the start; only a class's smallest id goes on.
2. Buckets with the same smallest member form one group (near copies share most
   of their bands). In each group every member is compared with one pivot, so m
   members give m - 1 pairs and not m * m. A pair's similarity is estimated
   from the agreeing registers, corrected for chance collisions of compressed
   registers of two such set sizes; plausible pairs (within five standard
   deviations) are verified on the full sets.
3. Verified links give components. A group whose members are all in one
   component is settled, whatever other pairs it holds. The others get further
   rounds with other pivots, and then all their remaining members are compared
   in groups of two blocks of ``BLOCK``, exactly and without emitting pairs:
   a group returns at most a spanning forest of new links.

Only sketches, ids and band keys of all documents travel; texts of documents
that share a bucket are read again for their full sets.

Defined results: null and empty texts, and texts of white space, have an empty
set, are linked with nothing and stand for themselves; rows that share an id
are one document with several texts; rows with a null id are not linked
(component null, kept). Other columns are ignored; an empty table gives an
empty result. Of a very long text a task holds its words, one hash a shingle and
256 bytes of registers; the blocks of a group hold their members' full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, mixed, release, small, small_batches, space_words, utf8, word_hashes

SHINGLE = 5
PERCENT = 80
BUCKETS = 128
ROWS = 4
MANTISSA = 10
BLOCK = 256
PIVOT_ROUNDS = 6
MEMO = 120_000
_A = np.random.default_rng(2021).integers(0, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(2022).integers(0, 2**63, BUCKETS, dtype=np.uint64)
_BANDS = mixed(np.arange(1, BUCKETS // ROWS + 1, dtype=np.uint64))


def shingle_set(text: bytes | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = space_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    h = word_hashes(words, memo)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(items: np.ndarray) -> np.ndarray:
    """Compressed registers of a set that isn't empty."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        np.minimum(least, (items[at : at + 256, None] * _A + _B).min(0), out=least)
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint16)
    bits = np.clip((2 * fraction - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | bits


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of four registers."""
    return mixed(registers.view(np.uint64) ^ _BANDS).view(np.int64)


_ZEROS = np.arange(54)
_WIDTH = 2.0 ** -(_ZEROS + 1)


def collision(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m items agree.

    Within a leading-zero class the 2**MANTISSA cells have equal width w; the
    minimum of n items lies in the cell at x with a chance of about n w exp(-n x).
    """
    total = np.asarray(n, float)[..., None] + np.asarray(m, float)[..., None]
    cells = _WIDTH / (1 << MANTISSA)
    area = (np.exp(-total * _WIDTH) - np.exp(-2 * total * _WIDTH)) / total
    return np.minimum((np.asarray(n, float)[..., None] * np.asarray(m, float)[..., None] * cells * area).sum(-1), 0.5)


def estimate(agree: np.ndarray | float, n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray:
    """Similarity from the share of agreeing registers, without chance collisions."""
    c = collision(n, m)
    return (agree - c) / (1 - c)


def plausible(percent: float) -> float:
    t = percent / 100
    return t - 5 * float(np.sqrt(t * (1 - t) / BUCKETS))


def linked(a: np.ndarray, b: np.ndarray, percent: float) -> bool:
    """Exact test on full sets (sorted and distinct)."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            counts, keys, registers = [], [], []
            for text in utf8(batch["text"]):
                items = shingle_set(text, size, memo)
                counts.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                registers.append(sketch(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return run


def _full_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            items = [shingle_set(t, size, memo) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([len(x) for x in items], pa.int64()), pa.array([x.tobytes() for x in items], pa.binary()), pa.array([sketch(x).tobytes() for x in items], pa.binary())], names=["rep", "n", "items", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(x, np.uint16).copy()) for x in utf8(batch["sketch"])]
        n = BUCKETS // ROWS
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch["rep"].to_numpy(), n), pa.int64())], names=["band", "rep"])


def _likely(percent: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose registers agree enough, chance collisions taken off."""
    least = plausible(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(utf8(batch[c])), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
                near = estimate((one == two).mean(1), batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(near >= least, pa.bool_()))

    return run


def _verify(percent: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(ia, np.uint64), np.frombuffer(ib, np.uint64), percent) for ia, ib in zip(utf8(batch["items_a"]), utf8(batch["items_b"]), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; only pairs whose sketches are near enough meet with them."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    likely = near.mapInArrow(_likely(percent), "a long, b long").distinct()
    return likely.join(side("a", "items"), "a").join(side("b", "items"), "b").select("a", "b", "items_a", "items_b").mapInArrow(_verify(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(v, comp)``: each vertex of ``edges (a, b)`` with the smallest vertex it reaches.

    Labels hop over edges and then jump to their label's label, which halves
    the way to the smallest; every round is written down, so lineage stays short.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("w")).agg(F.min("l").alias("near"))
        hopped = materialize(labels.join(near, labels["v"] == near["w"]).select("v", F.col("l").alias("was"), F.least("l", "near").alias("l")), "hop")
        further = hopped.select(F.col("v").alias("w"), F.col("l").alias("further"))
        jumped = materialize(hopped.join(further, hopped["l"] == further["w"]).select("v", "was", F.least("l", "further").alias("l")), "labels")
        discard(labels, hopped)
        labels = jumped
        if labels.where("l <> was").isEmpty():
            discard(both)
            return labels.select("v", F.col("l").alias("comp"))


def _forest(percent: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """New links inside a group of at most two blocks: a spanning forest over components, found exactly."""
    least = plausible(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").sort_values("rep")
        rep, comp = pdf["rep"].tolist(), pdf["comp"].tolist()
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        sketches = np.stack([np.frombuffer(x, np.uint16) for x in pdf["sketch"]])
        sizes = np.array([len(x) for x in items], float)
        out = []
        for i in range(len(rep) - 1):
            agree = (sketches[i + 1 :] == sketches[i]).mean(1)
            near = estimate(agree, sizes[i], sizes[i + 1 :])
            for j in np.flatnonzero(near >= least) + i + 1:
                x, y = find(comp[i]), find(comp[j])
                if x != y and linked(items[i], items[j], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((rep[i], rep[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Members of unsettled groups, two blocks at a time (or one, for a small group).

    Blocks hold neighbours by component, so that groups of one component are few and can be left out.
    """
    size = members.groupBy("key").agg(F.count("*").alias("__n")).withColumn("blocks", F.ceil(F.col("__n") / block).cast("int")).drop("__n")
    dealt = members.join(size, "key").withColumn("mine", F.pmod(F.xxhash64("comp", F.when(F.col("blocks") > 1, F.col("rep"))), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", "comp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))


def near_links(sketched: DataFrame, texts: DataFrame, shingle: int, percent: float, pivot_rounds: int = PIVOT_ROUNDS, block: int = BLOCK) -> DataFrame:
    """Verified links between class representatives ``sketched (rep, sketch)`` that connect all that is to be connected.

    ``texts (rep, text)`` are the representatives' texts.
    """
    banded = materialize(sketched.select("rep", "sketch").mapInArrow(_bands, "band long, rep long"), "bands")
    shared = small(banded.groupBy("band").agg(F.min("rep").alias("key"), F.max("rep").alias("hi")).where("key <> hi").select("band", "key"), "shared-bands")
    # buckets with one smallest member are one group, with that member as its pivot: near copies share many bands
    members = banded.join(shared, "band").select("key", "rep").distinct()
    members = materialize(members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key"), "buckets")
    discard(banded)
    wanted = small(members.select("rep").distinct(), "wanted")
    sets = materialize(texts.join(wanted, "rep", "left_semi").dropDuplicates(["rep", "text"]).mapInArrow(_full_sets(shingle), "rep long, n long, items binary, sketch binary"), "sets")
    release(texts.sparkSession)
    links = materialize(verified(_pivot_pairs(members.withColumn("comp", F.col("rep")), 0), sets, percent), "links")
    # a group of two is through: its one pair was compared
    opened = _unsettled(members.where("n > 2").select("key", "rep", "n"), components(links))
    for turn in range(1, pivot_rounds):
        large = opened.where(F.col("n") > block)
        if large.isEmpty():
            break
        found = materialize(verified(_pivot_pairs(large, turn), sets, percent), "links")
        if found.isEmpty():
            break
        links = materialize(links.union(found), "links")
        opened = _unsettled(opened.select("key", "rep", "n"), components(links))
    if opened.isEmpty():
        return links
    groups = _block_pairs(opened, block)
    # a group of one component has nothing left to find
    several = groups.groupBy("key", "x", "y").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "x", "y")
    asked = groups.join(several, ["key", "x", "y"], "left_semi").join(sets, "rep")
    return materialize(links.union(asked.groupBy("key", "x", "y").applyInPandas(_forest(percent), "a long, b long").distinct()), "links")


def _pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with its group's pivot, unless they are in one component: the smallest, later one drawn by the turn."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)) if turn else F.lit(0), F.col("rep"), F.col("comp"))
    pivots = members.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.rep").alias("b"), F.col("p.comp").alias("pc"))
    return members.join(pivots, "key").where("comp <> pc").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (``key, rep, n``), with their components, of groups that hold more than one component."""
    known = members.join(comps, members["rep"] == comps["v"], "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    mixed_keys = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return materialize(known.join(mixed_keys, "key", "left_semi"), "unsettled")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: float = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept, class_id`` (the smallest id with an equal set)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, set_key binary, sketch binary"), "sketches")
    real = rows.where("doc_id is not null and set_key is not null")
    classes = materialize(real.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = real.join(classes, (real["set_key"] == classes["set_key"]) & (real["doc_id"] == classes["rep"]), "left_semi").select(F.col("doc_id").alias("rep"), "sketch").distinct()
    links = near_links(chosen, texts.withColumnRenamed("doc_id", "rep").where("rep is not null"), shingle, percent)
    member = rows.select("doc_id", "n_shingles", "set_key").join(classes.withColumnRenamed("set_key", "k"), F.col("set_key") == F.col("k"), "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"))
    # an id on rows of several classes connects them
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("doc_id")
    bridges = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    comps = components(links.select("a", "b").union(bridges))
    out = member.join(comps, F.col("class_id") == F.col("v"), "left").select("doc_id", "n_shingles", F.coalesce("comp", "class_id").alias("component_id"), "class_id")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: float = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, and all its columns.

    Rows that share a kept id are one document: one of them stays.
    """
    (name,) = fresh(docs, "kept")
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[name]), "left_semi")
    unnamed = rows.where("doc_id is null")
    return rows.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(unnamed)
