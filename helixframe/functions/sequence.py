"""Column expressions and NumPy kernels on DNA strings.

Column expressions stay in whole-stage codegen. The kernels serve operators that
look at every base: exploding a read into a row a base and sorting the rows back
would shuffle a thousand times the input, while a kernel keeps the read in one
row and needs no exchange at all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit hash of each base, and what marks a position that isn't sampled.
BASE_HASH = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
BASES = "ACGT"

_CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _i
_LETTER = np.frombuffer(BASES.encode(), np.uint8)
_KNOWN = np.zeros(256, bool)
_KNOWN[_LETTER] = True


def reverse_complement(seq: Column) -> Column:
    """Complemented and reversed; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


def homopolymer_compressed(seq: Column) -> Column:
    """Runs of one character become one character."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def cigar_overlap(cigar: Column) -> Column:
    """``<n>M`` as a number; null for anything else, ``*`` included."""
    return F.when(cigar.rlike(r"^\d+M$"), F.regexp_extract(cigar, r"^(\d+)M$", 1).cast("int"))


def tag(line: Column, names: str) -> Column:
    """The first float tag of a tab-separated line among ``names`` (alternatives of a pattern)."""
    found = F.regexp_extract(line, rf"\t(?:{names}):[fi]:([0-9.eE+-]+)", 1)
    return F.when(found != "", found.cast("double"))


def dna(text: Column) -> Column:
    """A read made of a text: letters become bases in turn of the alphabet, all else goes."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cycled = "".join(BASES[i % 4] for i in range(26))
    return F.regexp_replace(F.translate(text, letters + letters.upper(), cycled * 2), "[^ACGT]", "")


def dna_with_breaks(text: Column, breaks: str = ".\n") -> Column:
    """The same, but the characters of ``breaks`` become N, which no base is known for."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cycled = "".join(BASES[i % 4] for i in range(26))
    return F.regexp_replace(F.translate(text, letters + letters.upper() + breaks, cycled * 2 + "N" * len(breaks)), "[^ACGTN]", "")


def unsigned_less(a: Column, b: Column) -> Column:
    """Whether a < b, both 64-bit patterns read as unsigned."""
    lowest = F.lit(-(2**63))
    return a.bitwiseXOR(lowest) < b.bitwiseXOR(lowest)


def unsigned_mod(a: Column, c: int) -> Column:
    """The unsigned 64-bit pattern a modulo a small c."""
    return F.pmod(F.pmod(F.shiftrightunsigned(a, 1), F.lit(c)) * 2 + a.bitwiseAND(F.lit(1)), F.lit(c))


def rotated(x: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """Rotate 64-bit values to the left."""
    x, n = np.asarray(x, np.uint64), np.asarray(n, np.uint64) & np.uint64(63)
    return (x << n) | np.where(n == 0, np.uint64(0), x >> ((np.uint64(64) - n) & np.uint64(63)))


_FORWARD = np.stack([rotated(BASE_HASH[b], (64 - np.arange(64)) % 64) for b in BASES])
_REVERSE = np.stack([rotated(BASE_HASH[b], np.arange(64)) for b in "TGCA"])


def codes(seq: bytes) -> np.ndarray:
    """0..3 for A, C, G, T; anything else counts as A."""
    return _CODE[np.frombuffer(seq, np.uint8)]


def compressed(seq: bytes, hpc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Codes and positions of a read's bases, only the first of each run if ``hpc``."""
    raw = np.frombuffer(seq, np.uint8)
    if not hpc or not len(raw):
        return _CODE[raw], np.arange(len(raw))
    at = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1])))
    return _CODE[raw[at]], at


def compressed_pieces(seq: bytes, hpc: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all stretches of A, C, G and T one after another, the number of the stretch that each stands in, and where each stretch starts."""
    raw = np.frombuffer(seq, np.uint8)
    known = _KNOWN[raw]
    fresh = known & ~np.concatenate(([False], known[:-1]))
    at = np.flatnonzero(known & (fresh | np.concatenate(([True], raw[1:] != raw[:-1]))) if hpc and len(raw) else known)
    return _CODE[raw[at]], np.cumsum(fresh)[at] - 1, np.flatnonzero(fresh)


def rolling(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-strand hash of every window of k codes, by cumulative exclusive or.

    With R rotating to the left, f(t) = R(PF(t) ^ PF(t - k), t) where PF adds up
    R(h(s_j), -j); likewise for the other strand with R(h(comp(s_j)), j).
    """
    n = len(code)
    if n < k:
        none = np.zeros(0, np.uint64)
        return none, none
    j = np.arange(n) % 64
    zero = np.zeros(1, np.uint64)
    pf = np.concatenate((zero, np.bitwise_xor.accumulate(_FORWARD[code, j])))
    pr = np.concatenate((zero, np.bitwise_xor.accumulate(_REVERSE[code, j])))
    t = np.arange(k - 1, n)
    return rotated(pf[k:] ^ pf[:-k], t % 64), rotated(pr[k:] ^ pr[:-k], (64 - (t - k + 1) % 64) % 64)


def middles(seq: bytes, at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The position of each run that both strands agree on: its first base for A and C, its last for G and T."""
    last = np.append(at[1:], len(seq)) - 1
    return np.where(code < 2, at, last)


def sampled(code: np.ndarray, order: int, compression: int, ends: bool = True, piece: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window index t, hash and base of each sampled window; without ``ends`` the first and the last window are never sampled.

    A window is kept if the smaller of its two hashes is divisible by the
    compression; the base comes from the quotient, complemented for the other
    strand, so both strands of a read give complementary samples. Codes of several
    pieces (numbered by ``piece``) are sampled as if each stood alone.
    """
    f, r = rolling(code, order)
    forward = f < r
    h = np.where(forward, f, r)
    keep = np.flatnonzero(h % np.uint64(compression) == 0)
    if piece is not None:
        keep = keep[piece[keep] == piece[keep + order - 1]]
    if not ends:
        keep = keep[(keep > 0) & (keep < len(h) - 1)]
        if piece is not None:
            keep = keep[(piece[keep - 1] == piece[keep]) & (piece[keep + order] == piece[keep])]
    digit = ((h[keep] // np.uint64(compression)) % np.uint64(4)).astype(np.int64)
    base = np.where(forward[keep], digit, 3 - digit)
    return keep + order - 1, h[keep], base


def letters(code: np.ndarray) -> str:
    return _LETTER[code].tobytes().decode()


def packed(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of k <= 31 codes as an integer, for both strands; numeric order is lexicographic order."""
    n = len(code) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none
    # words of w codes from those of half as many
    f = code.astype(np.int64)
    r = 3 - f
    w = 1
    for bit in f"{k:b}"[1:]:
        f, r = f[:-w] << 2 * w | f[w:], r[:-w] | r[w:] << 2 * w
        w *= 2
        if bit == "1":
            more = code[w:].astype(np.int64)
            f, r = f[:-1] << 2 | more, r[:-1] | (3 - more) << 2 * w
            w += 1
    return f, r


def keys(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each window of k codes, for both strands: the packed k-mer up to 31 bases, else its rolling hash."""
    if k <= 31:
        return packed(code, k)
    f, r = rolling(code, k)
    return f.view(np.int64), r.view(np.int64)


def unpacked(kmer: Column, k: int) -> Column:
    """The string of a packed k-mer."""
    digits = [F.substring(F.lit(BASES), (F.shiftright(kmer, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return F.concat(*digits)


def window_hash(seq: bytes) -> int:
    """Forward hash of one whole k-mer, as a signed 64-bit pattern."""
    f, _ = rolling(codes(seq), len(seq))
    return int(f.view(np.int64)[0]) if len(f) else 0
