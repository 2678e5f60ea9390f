"""Hashes, sampling and k-mers against a scalar roll and plain strings."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import containment, inflate, kernels, kmers

MASK = (1 << 64) - 1
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
dna = st.text("ACGT", max_size=120)


def rol(x, n):
    n %= 64
    return ((x << n) | (x >> (64 - n))) & MASK if n else x


def rc(s):
    return "".join(COMPLEMENT.get(c, "N") for c in reversed(s))


def scalar_hashes(s, k):
    out = []
    for t in range(k - 1, len(s)):
        w = s[t - k + 1 : t + 1]
        f = r = 0
        for j, b in enumerate(w):
            f ^= rol(S.BASE_HASH[b], k - 1 - j)
            r ^= rol(S.BASE_HASH[COMPLEMENT[b]], j)
        out.append((f, r))
    return out


def compressed(s):
    return "".join(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)


@given(dna, st.integers(1, 80))
@settings(max_examples=60, deadline=None)
def test_rolling_hash_equals_scalar(s, k):
    f, r = S.rolling(S.codes(s.encode()), k)
    assert list(zip(f.tolist(), r.tolist(), strict=True)) == scalar_hashes(s, k)


@given(dna)
@settings(max_examples=60, deadline=None)
def test_samples_don_t_depend_on_the_strand(s):
    a = S.sampled(S.compressed(s.encode())[0], 7, 3)[2]
    b = S.sampled(S.compressed(rc(s).encode())[0], 7, 3)[2]
    assert S.letters(a) == rc(S.letters(b))


@given(dna, st.integers(1, 31))
@settings(max_examples=60, deadline=None)
def test_packed_kmers(s, k):
    f, r = S.packed(S.codes(s.encode()), k)
    name = lambda x: "".join("ACGT"[x >> 2 * (k - 1 - i) & 3] for i in range(k))
    windows = [s[i : i + k] for i in range(len(s) - k + 1)]
    assert [name(x) for x in f.tolist()] == windows and [name(x) for x in r.tolist()] == [rc(w) for w in windows]


@pytest.mark.parametrize(("seq", "expected"), [("AACGN", "NCGTT"), ("", ""), ("acgt", "NNNN")])
def test_reverse_complement(spark, seq, expected):
    assert spark.createDataFrame([(seq,)], "s string").select(S.reverse_complement(F.col("s"))).first()[0] == expected


def test_compression_and_middles(spark):
    assert spark.createDataFrame([("AAACCGTTT",)], "s string").select(S.homopolymer_compressed(F.col("s"))).first()[0] == "ACGT"
    for run, middle in (("CCC", 4), ("GGG", 6)):
        seq = f"TATA{run}TA".encode()
        code, at = S.compressed(seq)
        assert S.middles(seq, at, code)[4] == middle


def test_unsigned_arithmetic(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), -12345678901]
    for r in spark.createDataFrame([(v,) for v in values], "a long").select("a", S.unsigned_mod(F.col("a"), 20).alias("m"), S.unsigned_less(F.col("a"), F.lit(5).cast("long")).alias("l")).collect():
        assert r["m"] == (r["a"] & MASK) % 20 and r["l"] == ((r["a"] & MASK) < 5)


def reads(seed, n=30):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 400)))) for i in range(n)] + [(n, None), (n + 1, ""), (None, "ACGT")]


def test_reduce_equals_scalar(spark):
    rows = reads(1)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    got = {r["read_id"]: r["seq"] for r in kernels.reduced(df, 21, 5).collect()}
    for i, s in rows:
        if i is None:
            continue
        bases = ""
        for f, r in scalar_hashes(compressed(s or ""), 21):
            if min(f, r) % 5 == 0:
                bases += "ACGT"[f // 5 % 4] if f < r else "TGCA"[r // 5 % 4]
        assert got.get(i, "") == bases


def test_counts_and_spectrum(spark):
    rows = reads(2)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    expected = Counter(min(w, rc(w)) for _, s in rows if s for w in (s[i : i + 5] for i in range(len(s) - 4)))
    assert {r["kmer"]: r["n"] for r in kmers.named_counts(df, 5).collect()} == expected
    assert {r["n"]: r["n_kmers"] for r in kmers.spectrum(df, 5).collect()} == Counter(expected.values())


def test_majority(spark):
    rows = [("h", s, i) for i, s in enumerate("pqppp")] + [("g", s, i) for i, s in enumerate("zyy")]
    got = {r["key"]: (r["seq"], r["confirmed"]) for r in kmers.majority(spark.createDataFrame(rows, "key string, seq string, ord long")).collect()}
    assert got == {"h": ("p", True), "g": ("z", False)}


def test_dictionary_brings_reduced_reads_back(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(6000))
    df = spark.createDataFrame([(1, seq)], "read_id long, seq string")
    words = inflate.dictionary(inflate.sightings(df, 21, 5))
    contig = kernels.reduced(df, 21, 5).withColumnRenamed("read_id", "seg")
    out = inflate.expanded(contig, words).first()
    assert out["missing"] == 0 and out["seq"] in seq and len(out["seq"]) > 4000


def test_inflation_from_end_to_end(spark):
    rng = random.Random(13)
    seqs = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    contigs = kernels.reduced(df, 21, 5).withColumnRenamed("read_id", "seg")
    contigs = contigs.unionByName(contigs.where("seg = 0").select(F.lit(2).cast("long").alias("seg"), S.reverse_complement(F.col("seq")).alias("seq")))
    contigs = contigs.unionByName(spark.createDataFrame([(3, "ACGTA"), (4, "AC" * 20)], "seg long, seq string"))
    out = {r["seg"]: (r["seq"], r["missing"]) for r in inflate.read_back(df, contigs, None, 21, 5).collect()}
    at = {r["read_id"]: (r["lo"], r["hi"]) for r in kernels.samples(df, 21, 5).groupBy("read_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    whole = {i: seqs[i][max(0, lo - 21) : hi + 22] for i, (lo, hi) in at.items()}
    assert out[0] == (whole[0], 0) and out[1] == (whole[1], 0) and out[2] == (rc(whole[0]), 0)
    assert out[3] == ("N" * 100, 0) and out[4] == ("N", 3)


def test_linked_contigs_are_read_back_to_overlap(spark):
    from helixframe.plans import relations

    rng = random.Random(14)
    seq = "".join(rng.choice("ACGT") for _ in range(8000))
    other = "".join(rng.choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([(0, seq), (1, rc(seq)), (2, other)], "read_id long, seq string")
    contigs, edges = relations.cut_reads(kernels.reduced(df.where("read_id = 0"), 21, 5), 100, 40)
    # every second contig the other way round
    odd = F.col("seg") % 2 == 1
    contigs = contigs.withColumn("seq", F.when(odd, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    edges = edges.select("a", ((F.col("ea") + F.col("a") % 2) % 2).cast("int").alias("ea"), "b", ((F.col("eb") + F.col("b") % 2) % 2).cast("int").alias("eb"), "overlap")
    long = inflate.read_back(df, contigs, edges, 21, 5).cache()
    got = {r["seg"]: rc(r["seq"]) if r["seg"] % 2 else r["seq"] for r in long.collect()}
    laps = {(r["a"], r["b"]): r["overlap"] for r in inflate.overlaps(edges, long.select("seg", "seq"), 1500, 700).collect()}
    line = got[0]
    for i in range(1, len(got)):
        lap = laps[i - 1, i]
        assert got[i] in seq and got[i - 1][-lap:] == got[i][:lap]
        line += got[i][lap:]
    at = kernels.samples(df.where("read_id = 0"), 21, 5).agg(F.min("pos"), F.max("pos")).first()
    assert len(got) > 10 and line == seq[max(0, at[0] - 21) : at[1] + 22] and long.agg(F.sum("missing")).first()[0] == 0
    # only needed windows leave the reads
    needed = inflate.word_list(inflate.asked(inflate.extended(contigs, edges)))
    seen = inflate.second_pass(df, needed, 21, 5)
    assert seen.where("read_id < 2").count() == 2 * needed.count() and seen.where("read_id = 2").count() == 0
    assert 0 < seen.where("full is not null").count() <= 4


def test_reconciliation(spark):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    df = spark.createDataFrame([(seq[50:200], seq[:90], seq[150:])], "m string, s string, e string")
    row = df.select(inflate.reconciled_start(F.col("m"), F.col("s")).alias("a"), inflate.reconciled_end(F.col("m"), F.col("e")).alias("b")).first()
    assert row["a"] == seq[:200] and row["b"] == seq[50:]


def test_overlaps(spark):
    rng = random.Random(5)
    s1 = "".join(rng.choice("ACGT") for _ in range(100))
    s2 = "".join(rng.choice("ACGT") for _ in range(5)) + s1[-30:] + "ACGTACGT"
    seqs = spark.createDataFrame([(1, s1), (2, s2), (3, "ACGT"), (4, rc(s2))], "seg long, seq string")
    links = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 3, 0), (1, 0, 2, 0), (1, 1, 4, 1)], "a long, ea int, b long, eb int")
    got = {(r["ea"], r["b"]): r["overlap"] for r in inflate.overlaps(links, seqs, 150, 70).collect()}
    assert got == {(1, 2): 35, (1, 3): 0, (0, 2): 70, (1, 4): 35}


def test_containment(spark):
    rng = random.Random(6)
    ref = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(3)]
    contigs = [(0, ref[0][20:120]), (1, rc(ref[1][5:80])), (2, "A" * 60), (3, ref[2][:50] + "A" * 20)]
    got = {r["seg"]: r["n_in"] for r in containment.containment(spark.createDataFrame(contigs, "seg long, seq string"), spark.createDataFrame(list(enumerate(ref)), "read_id long, seq string")).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0}


def test_containment_of_short_contigs(spark):
    rng = random.Random(16)
    ref = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(4)] + ["AC", ""]
    contigs = ["", "A", "GT", "ACGTA", ref[0][40:52], rc(ref[1][3:33]), ref[2][10:41], rc(ref[3][50:90]), "A" * 30]
    got = containment.containment(spark.createDataFrame(list(enumerate(contigs)), "seg long, seq string"), spark.createDataFrame(list(enumerate(ref)), "read_id long, seq string"))
    assert {r["seg"]: r["n_in"] for r in got.collect()} == {i: sum(c in r or rc(c) in r for r in ref) for i, c in enumerate(contigs)}


def test_containment_of_equal_repeated_and_unknown_letters(spark):
    rng = random.Random(18)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = text(80)
    ref = [text(50) + core + text(50) + core, rc(core), core[:40] + "N" + core[41:], "A" * 300, None, "", text(31)]
    ref += [core + text(5)] * 40
    contigs = [core, rc(core), core, core[3:60], core[:40] + "N" + core[41:70], "A" * 31, "A" * 299, "A" * 301, "ACN", text(35), ref[6], None, "", core[:40] + "A" + core[41:], "T" * 12]
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, seq string").repartition(3)
    got = {r["seg"]: r["n_in"] for r in containment.containment(frame(contigs, "seg"), frame(ref, "read_id")).collect()}
    assert got == {i: 0 if c is None else sum(r is not None and (c in r or rc(c) in r) for r in ref) for i, c in enumerate(contigs)}
    assert got[0] == got[1] == got[2] == 42
    none = containment.containment(frame(contigs, "seg"), frame(ref, "read_id").where("false"))
    assert {r["n_in"] for r in none.collect()} == {0} and none.count() == len(contigs)


def test_window_hash_of_one_kmer():
    f, _ = scalar_hashes("ACGTTGCA", 8)[0]
    assert np.uint64(S.window_hash(b"ACGTTGCA") & MASK) == np.uint64(f)


def test_pieces_at_unknown_letters(spark):
    rng = random.Random(21)
    parts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (90, 3, 120)]
    df = spark.createDataFrame([(1, "N" + parts[0] + "NN" + parts[1] + "x" + parts[2]), (2, None), (3, "NN"), (None, parts[0])], "read_id long, seq string")
    got = {(r["read_id"], r["piece"]): r["seq"] for r in kernels.reduced_pieces(df, 11, 3).collect()}
    each = spark.createDataFrame([(0, parts[0]), (2, parts[2])], "read_id long, seq string")
    whole = {r["read_id"]: r["seq"] for r in kernels.reduced(each, 11, 3).collect()}
    assert got == {(1, k): v for k, v in whole.items()} | {(None, 0): whole[0]}


def test_windows_at_the_ends_may_be_left_out():
    code = S.codes(b"ACGTTGCAACGT")
    every, inner = S.sampled(code, 3, 1)[0].tolist(), S.sampled(code, 3, 1, False)[0].tolist()
    assert every == list(range(2, 12)) and inner == list(range(3, 11))
