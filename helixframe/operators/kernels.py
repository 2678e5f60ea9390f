"""Arrow kernels: one pass over reads, rows out, no exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import prepare
from .sieve import passes

Batches = Iterator[pa.RecordBatch]

#: Bases of reads that a kernel looks at together: its arrays grow with these, not with a batch's thousands of reads.
SLICE = 1 << 20


def sliced(batches: Batches, most: int = SLICE) -> Batches:
    """The same rows in batches of at most ``most`` bases, or of one read."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["seq"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _rows(ids: list, parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """Long rows of several reads: the id repeated beside each read's columns."""
    sizes = [len(p[0]) for p in parts]
    first = pa.array(np.repeat(np.array(ids, np.int64), sizes) if ids else np.zeros(0, np.int64), pa.int64())
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([first, *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns)], names=names)


def each(reads: DataFrame, names: list[str], kernel: Callable[[bytes], tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows of numbers that ``kernel`` finds in each sequence, with its id in front."""
    prepare(reads.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            ids, parts = [], []
            for i, seq in zip(batch["read_id"].to_pylist(), batch["seq"].to_pylist(), strict=True):
                if i is not None and seq is not None:
                    ids.append(i)
                    parts.append(kernel(seq.encode("ascii", "replace")))
            yield _rows(ids, parts, names)

    return reads.select("read_id", "seq").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def dna_reads(texts: DataFrame) -> DataFrame:
    """``read_id, seq`` of texts under the same names: letters become bases in turn of the alphabet, all else goes, as ``S.dna`` has it letter by letter."""
    prepare(texts.sparkSession)
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = bytes.maketrans(letters, bytes(ord(S.BASES[i % 26 % 4]) for i in range(52)))
    other = bytes(set(range(256)) - set(letters))

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 4 * SLICE):
            found = [x if x is None else x.translate(bases, other) for x in batch["seq"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["read_id"], pa.array(found, pa.binary()).cast(pa.string())], names=["read_id", "seq"])

    return texts.select("read_id", "seq").mapInArrow(run, texts.select("read_id", "seq").schema)


def rolling_hashes(reads: DataFrame, order: int, hpc: bool = True) -> DataFrame:
    """``read_id, t, forward, reverse`` for every window of ``order`` symbols."""

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        f, r = S.rolling(S.compressed(seq, hpc)[0], order)
        return np.arange(len(f)) + order - 1, f, r

    return each(reads, ["read_id", "t", "forward", "reverse"], kernel)


def samples(reads: DataFrame, order: int, compression: int, hpc: bool = True) -> DataFrame:
    """``read_id, t, pos, hash, base`` of sampled windows; pos is where the window's middle run stands in the read."""

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        code, at = S.compressed(seq, hpc)
        t, h, base = S.sampled(code, order, compression)
        where = S.middles(seq, at, code)[t - order // 2] if len(t) else t
        return t, where, h, base

    out = each(reads, ["read_id", "t", "pos", "hash", "digit"], kernel)
    return out.select("read_id", "t", "pos", "hash", F.substring(F.lit(S.BASES), (F.col("digit") + 1).cast("int"), F.lit(1)).alias("base"))


def run_middles(reads: DataFrame) -> DataFrame:
    """``read_id, run, pos, digit``: each run's position that both strands agree on."""

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        code, at = S.compressed(seq)
        return np.arange(len(at)), S.middles(seq, at, code), code

    return each(reads, ["read_id", "run", "pos", "digit"], kernel)


def reduced(reads: DataFrame, order: int, compression: int, hpc: bool = True, ends: bool = True) -> DataFrame:
    """Each read's sampled bases as one shorter read; reads without a sample have none."""
    prepare(reads.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, seqs = [], []
            for i, seq in zip(batch["read_id"].to_pylist(), batch["seq"].to_pylist(), strict=True):
                if seq is None:
                    continue
                base = S.sampled(S.compressed(seq.encode("ascii", "replace"), hpc)[0], order, compression, ends)[2]
                if len(base):
                    ids.append(i)
                    seqs.append(S.letters(base))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.string())], names=["read_id", "seq"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, seq string")


def reduced_pieces(reads: DataFrame, order: int, compression: int, hpc: bool = True, ends: bool = True) -> DataFrame:
    """``read_id, piece, seq``: stretches of A, C, G and T reduced each for itself; a read's pieces count from 0, empty ones too."""
    prepare(reads.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches):
            texts = [(x or "").encode("ascii", "replace") for x in batch["seq"].to_pylist()]
            code, piece, first = S.compressed_pieces(b"N".join(texts), hpc)
            t, _, base = S.sampled(code, order, compression, ends, piece)
            found, at = np.unique(piece[t], return_index=True)
            size = np.array([len(x) + 1 for x in texts], np.int64)
            offset = np.cumsum(size) - size
            read = np.searchsorted(offset, first[found], "right") - 1
            number = found - np.searchsorted(first, offset)[read]
            letters = S.letters(base).encode()
            seqs = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(np.append(at, len(base)).astype(np.int32)), pa.py_buffer(letters)])
            yield pa.RecordBatch.from_arrays([batch["read_id"].take(pa.array(read)).cast(pa.int64()), pa.array(number, pa.int32()), seqs], names=["read_id", "piece", "seq"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, piece int, seq string")


def packed_kmers(reads: DataFrame, k: int) -> DataFrame:
    """``kmer, n``: canonical packed k-mers, already counted within each slice of a batch, so the shuffle sees partial sums."""
    prepare(reads.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, 4 * SLICE):
            found = []
            for seq in batch["seq"].to_pylist():
                if seq:
                    f, r = S.packed(S.codes(seq.encode("ascii", "replace")), k)
                    found.append(np.minimum(f, r))
            kmers, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmers, pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])

    return reads.select("seq").mapInArrow(run, "kmer long, n long")


def kmer_places(reads: DataFrame, k: int, stride: int = 1) -> DataFrame:
    """``read_id, pos, forward, reverse``: keys of k-mers of both strands at every ``stride``-th position."""

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        f, r = S.keys(S.codes(seq), k)
        return np.arange(len(f))[::stride], f[::stride], r[::stride]

    return each(reads, ["read_id", "pos", "forward", "reverse"], kernel)


def probes(reads: DataFrame, k: int, wanted: Broadcast) -> DataFrame:
    """``read_id, pos, kmer, fwd`` (1 or 0): read k-mers, either strand, that the sieve ``wanted`` lets through."""

    def kernel(seq: bytes) -> tuple[np.ndarray, ...]:
        both = S.keys(S.codes(seq), k)
        at = [np.flatnonzero(passes(wanted.value, x)) for x in both]
        return np.concatenate(at), np.concatenate([x[p] for x, p in zip(both, at, strict=True)]), np.repeat((1, 0), [len(p) for p in at])

    return each(reads, ["read_id", "pos", "kmer", "fwd"], kernel)


def whole_hashes(reads: DataFrame) -> DataFrame:
    """``read_id, hash``: the forward hash of each sequence as one k-mer."""
    return each(reads, ["read_id", "hash"], lambda seq: (S.rolling(S.codes(seq), len(seq))[0][:1],) if seq else (np.zeros(0, np.uint64),))
