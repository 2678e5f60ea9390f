"""Which references hold a contig, or its reverse complement: rarest seeds, then hashes; no pair of texts ever meets.

Every contig and every stretch of a reference has two 64-bit polynomial hashes, from prefix sums over its
bytes; texts count as equal if both agree. Equal contigs (on either strand) are looked up once.

*Long contigs* (at least k bases). How often each of their k-mers stands in all references is counted behind a
sieve; a contig with a k-mer that stands nowhere is in none. Its rarest k-mer is its seed. Only places of seeds leave the
second scan. A place and the seed's offset say where the contig would lie; with the places
of a reference joined to its text, the stretch's hashes are compared with the contig's.

*Short contigs* are looked up by their own hashes, all lengths in one scan. A reference counts
once for each, and a batch hands on counts, so a contig in all references costs one row a batch.

An empty contig is in every reference; null ones are in none and hold none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import prepare
from . import kernels
from .loop import written
from .sieve import passes, sieve

K = 31
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_FLIP = np.full(256, ord("N"), np.uint8)
_FLIP[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]


class Hashed:
    """Prefix sums of one text, for the two hashes of any stretch."""

    def __init__(self, raw: np.ndarray, powers: dict[int, tuple[np.ndarray, np.ndarray]]):
        n = len(raw)
        self.both = []
        for base in BASES:
            if base not in powers or len(powers[base][0]) <= n:
                many = 1 << max(n + 1, 1024).bit_length()
                steps = [np.full(many, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
                for x in steps:
                    x[0] = 1
                powers[base] = tuple(np.multiply.accumulate(x) for x in steps)
            up, down = powers[base]
            self.both.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n]))), down))

    def stretch(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the bytes in [a, b)."""
        return tuple(((sums[b] - sums[a]) * down[a]).view(np.int64) for sums, down in self.both)


def _raw(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return raw, _FLIP[raw[::-1]]


def _smaller(f: tuple[np.ndarray, np.ndarray], r: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    turned = (r[0] < f[0]) | ((r[0] == f[0]) & (r[1] < f[1]))
    return np.where(turned, r[0], f[0]), np.where(turned, r[1], f[1])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers: dict = {}
    for batch in batches:
        rows = []
        for seg, text in zip(batch["seg"].to_pylist(), batch["seq"].to_pylist(), strict=True):
            both = [Hashed(x, powers).stretch(np.array([0]), np.array([len(x)])) for x in _raw(text)]
            low = _smaller(*both)
            rows.append((seg, len(text), *(int(x[0]) for x in (*both[0], *both[1], *low))))
        names = ["seg", "size", "f1", "f2", "r1", "r2", "c1", "c2"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _short(sizes: list[int], wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``size, c1, c2, n``: in how many texts of a batch each stretch of these lengths stands that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            found: list[np.ndarray] = []
            for text in batch["seq"].to_pylist():
                raw, other = _raw(text)
                forward, reverse = Hashed(raw, powers), Hashed(other, powers)
                for size in sizes:
                    a = np.arange(len(raw) - size + 1)
                    if len(a):
                        low = _smaller(forward.stretch(a, a + size), reverse.stretch(a[::-1], a[::-1] + size))
                        some = np.flatnonzero(passes(wanted.value, low[0]))
                        if len(some):
                            found.append(np.unique(np.stack([np.full(len(some), size), low[0][some], low[1][some]], 1), axis=0))
            rows, n = np.unique(np.concatenate(found) if found else np.zeros((0, 3), np.int64), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i], pa.int64()) for i in range(3)), pa.array(n, pa.int64())], names=["size", "c1", "c2", "n"])

    return run


def _counted(k: int, wanted: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch["seq"].to_pylist():
                low = np.minimum(*S.packed(S.codes(text.encode("ascii", "replace")), k))
                found.append(low[passes(wanted.value, low)])
            kmer, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seg, n``: how many texts of a batch have a contig where their candidates say."""
    powers: dict = {}
    for batch in batches:
        found = []
        for text, asked in zip(batch["seq"].to_pylist(), batch["asked"], strict=True):
            own = asked.values
            start, size, h1, h2, seg = (own.field(c).to_numpy() for c in ("start", "size", "h1", "h2", "seg"))
            inside = (start >= 0) & (start + size <= len(text))
            at = np.where(inside, start, 0)
            one, two = Hashed(_raw(text)[0], powers).stretch(at, np.where(inside, start + size, 0))
            found.append(np.unique(seg[inside & (one == h1) & (two == h2)]))
        seg, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(n, pa.int64())], names=["seg", "n"])


def containment(contigs: DataFrame, references: DataFrame, k: int = K) -> DataFrame:
    """``seg, n_in``: how many references (``read_id, seq``) hold the contig or its reverse complement."""
    prepare(contigs.sparkSession)
    texts = references.where("seq is not null").select("read_id", "seq")
    kinds = ", ".join(f"{n} long" for n in ("seg", "size", "f1", "f2", "r1", "r2", "c1", "c2"))
    named = written(contigs.where("seq is not null").select("seg", "seq").mapInArrow(_named, kinds), "contigs")
    sizes = sorted(r["size"] for r in named.where((F.col("size") > 0) & (F.col("size") < k)).select("size").distinct().collect())
    key = ["size", "c1", "c2"]
    found = named.where("size = 0").select(*key).distinct().withColumn("n", F.lit(texts.count()).cast("long"))
    if sizes:
        wanted = sieve(named.where(F.col("size").isin(sizes)).select(F.col("c1").alias("key")))
        found = found.unionByName(texts.mapInArrow(_short(sizes, wanted), "size long, c1 long, c2 long, n long").groupBy(*key).agg(F.sum("n").alias("n")))
    # one of equal contigs, its k-mers with their offsets
    long = written(named.where(F.col("size") >= k).groupBy(*key).agg(F.min(F.struct("seg", "f1", "f2", "r1", "r2")).alias("x")).select(*key, "x.*"), "long")
    own = contigs.select("seg", "seq").join(long.select("seg"), "seg", "left_semi").withColumnRenamed("seg", "read_id")

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        f, r = S.packed(S.codes(seq), k)
        return np.arange(len(f)), np.minimum(f, r), (r < f).astype(np.int64)

    offsets = written(kernels.each(own, ["seg", "at", "kmer", "turned"], kernel), "offsets")
    counts = texts.mapInArrow(_counted(k, sieve(offsets.select(F.col("kmer").alias("key")))), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("kmer").alias("h"), "at", "kmer", "turned"))
    seeds = written(offsets.join(counts, "kmer", "left").groupBy("seg").agg(rarest.alias("x")).where("x.n > 0").select("seg", "x.at", "x.kmer", "x.turned").join(long, "seg"), "seeds")
    held = sieve(seeds.select(F.col("kmer").alias("key")))

    def placed(seq: bytes) -> tuple[np.ndarray, ...]:
        f, r = S.packed(S.codes(seq), k)
        low = np.minimum(f, r)
        at = np.flatnonzero(passes(held.value, low))
        return at, low[at], (r < f)[at].astype(np.int64)

    places = kernels.each(texts, ["read_id", "pos", "kmer", "way"], placed)
    same = F.col("way") == F.col("turned")
    start = F.col("pos") - F.when(same, F.col("at")).otherwise(F.col("size") - k - F.col("at"))
    asked = places.join(seeds, "kmer").select("read_id", F.struct(start.alias("start"), "size", F.when(same, F.col("f1")).otherwise(F.col("r1")).alias("h1"), F.when(same, F.col("f2")).otherwise(F.col("r2")).alias("h2"), "seg").alias("a"))
    asked = asked.groupBy("read_id").agg(F.collect_list("a").alias("asked"))
    hits = texts.join(asked, "read_id").select("seq", "asked").mapInArrow(_verified, "seg long, n long").groupBy("seg").agg(F.sum("n").alias("n"))
    found = written(found.unionByName(hits.join(long, "seg").select(*key, "n")), "found")
    out = contigs.select("seg").join(named.join(found, key).select("seg", "n"), "seg", "left")
    return out.select("seg", F.coalesce("n", F.lit(0)).alias("n_in"))
