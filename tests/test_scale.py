"""What must hold on large inputs: work and memory that don't grow with a batch, a bucket or a text's length."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import align, inflate, kernels, longmers


def _dna(n, seed=0):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def _start(seq, full):
    for o in range(len(full), 0, -1):
        m = min(o, 30, len(seq))
        if full[len(full) - o :][:m] == seq[:m]:
            return full[: len(full) - o] + seq
    return full + seq


def _end(seq, full):
    for o in range(min(len(full), len(seq)), 0, -1):
        m = min(o, 30)
        if full[o - m : o] == seq[len(seq) - m :]:
            return seq + full[o:]
    return seq + full


def test_overlaps_equal_a_plain_search(spark):
    rng = random.Random(5)
    pairs = [("ACGT", ""), ("", "ACGT"), ("A" * 40, "A" * 50), ("AC" * 30, "CA" * 25)]
    for _ in range(200):
        a = _dna(rng.randrange(1, 90), rng.random())
        lap = rng.randrange(0, len(a) + 1)
        pairs += [(a, _dna(rng.randrange(0, 60), rng.random()) + a[:lap]), (a, a[len(a) - lap :] + _dna(rng.randrange(0, 60), rng.random()))]
    rows = spark.createDataFrame([(i, s, f) for i, (s, f) in enumerate(pairs)], "i long, s string, f string")
    found = rows.select("i", inflate.reconciled_start(F.col("s"), F.col("f")).alias("a"), inflate.reconciled_end(F.col("s"), F.col("f")).alias("b")).collect()
    for r in found:
        s, f = pairs[r["i"]]
        assert r["a"] == (_start(s, f) if f else s)
        assert r["b"] == (_end(s, f) if f and s else s)


def test_overlap_of_a_long_text_is_one_search(spark):
    full, seq = _dna(150_000, 1), _dna(40, 2)
    row = spark.createDataFrame([(seq, full)], "s string, f string")
    start = time.perf_counter()
    got = row.select(F.length(inflate.reconciled_start(F.col("s"), F.col("f"))) + F.length(inflate.reconciled_end(F.col("f"), F.col("s")))).first()[0]
    assert got >= 300_000 and time.perf_counter() - start < 15


def _reads(n, size):
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([_dna(size, i) if i % 7 else None for i in range(n)])], names=["read_id", "seq"])


def test_slices_hold_all_rows_and_few_bases():
    batch = _reads(50, 1000)
    found = list(kernels.sliced(iter([batch, batch]), 3500))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch, batch]).combine_chunks())
    assert all(b.num_rows == 1 or sum(len(s or "") for s in b["seq"].to_pylist()) <= 3500 for b in found)


def test_kernels_answer_in_slices(spark):
    """One large batch leaves a kernel as several, so that a worker never holds a batch's rows at once."""
    kept = {}

    class Frame:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            kept["run"] = run
            return self

    batch = _reads(3000, 2000)
    for make, least in ((lambda f: kernels.each(f, ["read_id", "x"], lambda s: (np.arange(len(s)),)), 5), (lambda f: kernels.packed_kmers(f, 21), 2), (lambda f: inflate.sightings(f, 31, 20), 5)):
        make(Frame())
        sizes = [b.num_rows for b in kept["run"](iter([batch]))]
        assert len(sizes) >= least and max(sizes) <= 4 * kernels.SLICE


def test_pieces_equal_reads_reduced_one_by_one(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ACGTN", [9, 9, 9, 9, rng.random()], k=rng.randrange(0, 900)))) for i in range(60)] + [(90, None), (91, ""), (92, "NN"), (93, "n?é")]
    for hpc in (True, False):
        for ends in (True, False):
            want = set()
            for i, text in rows:
                for n, piece in enumerate(re.findall(rb"[ACGT]+", (text or "").encode("ascii", "replace"))):
                    base = S.sampled(S.compressed(piece, hpc)[0], 15, 4, ends)[2]
                    if len(base):
                        want.add((i, n, S.letters(base)))
            found = kernels.reduced_pieces(spark.createDataFrame(rows, "read_id long, seq string"), 15, 4, hpc, ends).collect()
            assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_a_bucket_holds_bytes_not_indexes():
    k, packed = 101, {}
    reads = pa.RecordBatch.from_arrays([pa.array([_dna(2000, i) for i in range(40)])], names=["seq"])
    rows = pa.Table.from_batches(longmers._pieces(k, 1, np.zeros(0, np.uint64))(iter([reads]))).select(["bucket", "shape", "packed", "n"])
    for name, make in (("counted", longmers._counted(k, 1)), ("joined", lambda t: longmers.Bucket(t, k, 1).mates())):
        tracemalloc.start()
        make(rows)
        packed[name] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    # 76,000 k-mers of 101 bases: an index of their bases alone is 61 MB
    assert max(packed.values()) < 55e6, packed


def test_long_windows_of_words_have_many_names():
    rng = random.Random(1)
    words = [_dna(rng.randrange(3, 9), i) for i in range(2000)]
    code = S.codes("".join(rng.choice(words) for _ in range(300_000)).encode())

    def hot(m):
        n = np.unique(longmers.minimizers(code, 190, m), return_counts=True)[1]
        return n[n > n.sum() / longmers.HOT].sum() / n.sum()

    assert hot(longmers._shape(191)) < 0.5 * hot(11)


def test_hits_are_replayed_few_at_a_time():
    hits = [{"pos": p, "seg": p % 3, "cpos": 0, "fwd": True, "size": 40} for p in range(0, 4000, 2)]
    shape = pa.list_(pa.struct([("pos", pa.int64()), ("seg", pa.int64()), ("cpos", pa.int64()), ("fwd", pa.bool_()), ("size", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([5000] * 200, pa.int32()), pa.array([hits] * 200, shape)], names=["read_id", "read_size", "hits"])
    found = list(align._replayed(31)(iter([batch])))
    one = pa.Table.from_batches(align._replayed(31)(iter([batch.slice(0, 1)])))
    assert len(found) > 4 and sum(b.num_rows for b in found) == 200 * one.num_rows
    # each batch left before the next one's hits became objects
    assert max(b.num_rows for b in found) <= one.num_rows * align.HITS // len(hits)


def test_extensions_choose_by_number_and_skip_unknown_segments(spark):
    links = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 3, 1), (1, 1, 9, 0), (2, 0, 1, 1)], "a long, ea int, b long, eb int")
    texts = spark.createDataFrame([(1, "AACCGGTTAC"), (2, "ACGTACGT"), (3, "TTTGGGCCCA")], "seg long, seq string")
    found = inflate.end_extensions(links, texts, 2, 3)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "GGC"), (2, 0, "AAC")]
    # no whole sequence in the plan's aggregates
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "text" in x]


def test_rounds_of_trimming_write_open_links_only(spark, monkeypatch):
    from helixframe.operators import edit

    # pairs that are settled at once, and one line whose ends act one after another
    line = [(i, 1, i + 1, 0, 1 + i % 3) for i in range(16)]
    pairs = [(1000 + 2 * i, 1, 1001 + 2 * i, 0, 5) for i in range(200)]
    edges = spark.createDataFrame([y for a, ea, b, eb, x in line + pairs for y in ((a, ea, b, eb, x), (b, eb, a, ea, x))], "a long, ea int, b long, eb int, overlap int")
    segments = spark.createDataFrame([(i, 4) for i in range(17)] + [(1000 + i, 100) for i in range(400)], "seg long, length int")
    sizes, write = [], edit.written

    def counting(df, tag):
        out = write(df, tag)
        if tag in ("overlaps", "tagged"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(edit, "written", counting)
    lost, left = edit.trimmed_overlaps(segments, edges)
    assert sizes[0] == 432 and len(sizes) > 4 and all(n <= 60 for n in sizes[3:])
    assert {r["overlap"] for r in left.where("a >= 1000").collect()} == {0} and lost.count() == 417


def test_rounds_of_copying_write_their_copies_only(spark, monkeypatch):
    from helixframe.operators import edit

    # s is copied for x and y, then t for the copies' sake; 200 links have nothing to copy
    links = [(0, 1, 2, 0), (1, 1, 2, 0), (2, 1, 3, 0), (3, 1, 4, 0), (3, 1, 5, 0)] + [(1000 + 2 * i, 1, 1001 + 2 * i, 0) for i in range(200)]
    edges = spark.createDataFrame([y for a, ea, b, eb in links for y in ((a, ea, b, eb), (b, eb, a, ea))], "a long, ea int, b long, eb int")
    segments = spark.createDataFrame([(i, 100, 20.0 if i in (2, 3) else 10.0) for i in range(6)] + [(1000 + i, 100, 9.0) for i in range(400)], "seg long, length int, coverage double")
    sizes, write = [], edit.written

    def counting(df, tag):
        out = write(df, tag)
        if tag in ("segments", "edges"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(edit, "written", counting)
    whole, left = edit.duplicated(segments, edges, edit.shared_ends)
    assert sizes[:2] == [406, 410] and len(sizes) > 4 and all(n <= 20 for n in sizes[2:])
    assert sorted(r["coverage"] for r in whole.where("length = 100 and coverage > 9").collect()) == [10.0] * 8
    assert left.count() == 416 and edit.unpaired(left).count() == 0


def test_links_are_made_distinct_before_they_are_turned_round(spark):
    from helixframe.plans import relations

    links = spark.createDataFrame([(1, 1, 2, 0), (2, 0, 1, 1), (3, 1, 3, 1), (4, 0, 4, 1), (5, 1, 1, 1)], "a long, ea int, b long, eb int")
    both = relations.mirrored(links)
    assert sorted(map(tuple, both.collect())) == [(1, 1, 2, 0), (1, 1, 5, 1), (2, 0, 1, 1), (3, 1, 3, 1), (4, 0, 4, 1), (4, 1, 4, 0), (5, 1, 1, 1)]
    # one shuffle, and each link in it once
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_tries_shuffle_paths_once_a_level_and_deal_out_busy_sides(spark, monkeypatch):
    from helixframe.operators import walks

    rows = [(r, i, x, True) for r in range(40) for i, x in enumerate([1, 2 + r % 4, 7 + r % 3, 11])]
    steps = spark.createDataFrame(rows, "read_id long, idx int, seg long, fwd boolean")
    shape = "seg long, side int, read_id long, at int, ahead boolean, n int, nodes array<long>"
    plain = sorted(map(tuple, walks.prefix_support(steps).collect()))
    assert ((1, 1, ">2", 1, 10, 30)) in plain and ((1, 1, ">2>7", 2, 4, 6)) in plain
    named = walks.Beyond(steps).walks.mapInArrow(walks._named(0, 8), shape)
    few, all_ = (walks.Beyond._counted(named, 0, often).select("seg", "side", "path", "n", "w", "facts") for often in (5, 10_000))
    key = lambda df: sorted((*r[:5], sorted((x["depth"], x["support"], x["against"]) for x in r["facts"])) for r in df.collect())
    assert key(few) == key(all_)
    # no path's prefixes are shuffled: one exchange of paths, none behind the explode
    plan = all_._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_enumerated_walks_are_not_shuffled_to_be_counted(spark):
    from helixframe.operators import paths

    # 0 goes to seven segments and each of these to seven more, 100 to two
    links = [(0, 1, i, 0) for i in range(1, 8)] + [(i, 1, 10 * i + j, 0) for i in range(1, 8) for j in range(7)] + [(100, 1, 101, 0), (100, 1, 102, 0)]
    edges = spark.createDataFrame([y for a, ea, b, eb in links for y in ((a, ea, b, eb), (b, eb, a, ea))], "a long, ea int, b long, eb int").distinct()
    segments = spark.createDataFrame([(i, 10) for i in {x for a, _, b, _ in links for x in (a, b)}], "seg long, length int")
    starts = spark.createDataFrame([(s, 1, 20) for s in (0, 100)], "seg long, end int, budget int")
    plans, found = {}, {}
    for most in (49, 50):
        out = paths.bounded(starts, edges, segments, most)
        found[most] = sorted((r["seg"], r["length"]) for r in out.collect())
        plans[most] = out._jdf.queryExecution().optimizedPlan().toString()
    assert found == {49: [(100, 10)] * 2, 50: [(0, 20)] * 49 + [(100, 10)] * 2}
    assert all("LeftSemi" not in p and "Aggregate" not in p for p in plans.values())


def test_pieces_of_a_slice_leave_as_one_row_a_bucket():
    reads = pa.RecordBatch.from_arrays([pa.array([_dna(3000, i % 30) for i in range(40)])], names=["seq"])
    rows = pa.Table.from_batches(longmers._pieces(61, 7, np.zeros(0, np.uint64))(iter([reads])))
    assert rows["bucket"].to_pylist() == list(range(7))
    n = np.frombuffer(b"".join(rows["n"].to_pylist()), np.int32)
    # ten reads occur twice
    assert set(n.tolist()) == {1, 2} and sum(len(x) for x in rows["shape"].to_pylist()) == 4 * len(n)


def test_unlike_kmers_of_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    want = sorted(np.unique(np.stack(columns), axis=1, return_counts=True)[1].tolist())
    for hashed in (longmers._hashed, lambda c: np.zeros(len(c[0]), np.uint64)):
        monkeypatch.setattr(longmers, "_hashed", hashed)
        order, head = longmers._grouped(columns)
        assert sorted(np.diff(np.append(head, 500)).tolist()) == want
        assert len({tuple(int(c[i]) for c in columns) for i in order[head]}) == len(want)


def test_long_kmers_are_summed_up_where_they_are_counted(spark, monkeypatch):
    from helixframe.plans import catalogue

    reads = [_dna(400, i % 40) for i in range(60)] + ["ACGT" * 60, None, ""]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").repartition(3)
    monkeypatch.setattr(catalogue.R, "reads", lambda spark, sf_dir: df)
    monkeypatch.setattr(longmers, "OUTLINED", 50)
    want = {}
    for k in (61, 101):
        for r in longmers.counts(df, k).collect():
            want.setdefault((k, r["kmer"][:8], r["n"]), []).append(r["kmer"])
    found = catalogue.kmer_count_long(spark, "")
    assert sorted(map(tuple, found.collect())) == sorted((*key, len(x), min(x), max(x)) for key, x in want.items())
    # what leaves the kernel has no k-mers but the smallest and the largest of each sum, once a task
    assert "kmer#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_become_bases_in_a_kernel_as_they_do_in_sql(spark):
    texts = ["Abc xyz\n", "", None, "ÄöN' 12 – Zz", "\u0000q\U0001f600W"]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    assert kernels.dna_reads(df).collect() == df.select("read_id", S.dna(F.col("seq")).alias("seq")).collect()


def test_settled_nodes_are_read_only_while_pointers_name_them(spark, monkeypatch):
    from helixframe.operators import contract

    # one chain of 200 segments, and 300 of two that are settled after the first round
    links = [(i, 1, i + 1, 0) for i in range(199)] + [(1000 + 2 * i, 1, 1001 + 2 * i, 0) for i in range(300)]
    edges = spark.createDataFrame([y for a, ea, b, eb in links for y in ((a, ea, b, eb), (b, eb, a, ea))], "a long, ea int, b long, eb int")
    segments = spark.createDataFrame([(i,) for i in [*range(200), *range(1000, 1600)]], "seg long")
    sizes, write = [], contract.written

    def counting(df, tag):
        out = write(df, tag)
        if tag == "asked":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(contract, "written", counting)
    found = {r["seg"]: (r["chain"], r["idx"]) for r in contract.chains(segments, edges, small=0).collect()}
    assert all(found[i] == (0, i) for i in range(200)) and all(found[1001 + 2 * i] == (1000 + 2 * i, 1) for i in range(300))
    # 602 heads at first; then few besides the long chain's
    assert sizes[0] >= 602 and len(sizes) > 6 and max(sizes[1:]) < 400


def test_many_contigs_are_looked_up_in_buckets(spark, monkeypatch):
    from helixframe.operators import kmers, lookup

    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = [_dna(500, i) for i in range(12)]
    reads = spark.createDataFrame([(i, t if i % 3 else turn(t)) for i, t in enumerate(texts)] + [(20, "A" * 300), (21, None), (22, "ACGT"), (23, texts[1] + texts[2])], "read_id long, seq string").repartition(2)
    pieces = [t[a : a + 100] for t in texts[:9] for a in range(0, 470, 70)] + ["A" * 90, "ACGT", texts[3][:100], turn(texts[4])[:100]]
    contigs = spark.createDataFrame(list(enumerate(pieces)), "seg long, seq string").repartition(2)
    monkeypatch.setattr(lookup, "SLICE", 300)
    for k, stride in ((31, 5), (21, 1), (29, 7)):
        want = kmers.contig_hits(reads, contigs, k, stride).select("read_id", "pos", "seg", "cpos", "fwd").collect()
        found = lookup.hits(reads, contigs, k, stride)
        got = [tuple(r) for r in found.collect()]
        assert sorted(x[:5] for x in got) == sorted(map(tuple, want)) and len(want) > 300
        assert all(x[5] == len(pieces[x[2]]) for x in got)
    plain = sorted(map(tuple, align.visited(reads, contigs, 31).collect()))
    monkeypatch.setattr(align, "SIEVED", 0)
    # no row a k-mer is shuffled to meet its partner
    walked = align.visited(reads, contigs, 31)
    assert sorted(map(tuple, walked.collect())) == plain and "kmer#" not in walked._jdf.queryExecution().optimizedPlan().toString()


def test_dictionaries_shuffle_packed_texts_once(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ACGTN", [9, 9, 9, 9, 0.1], k=n))
    long = [text(1500) for _ in range(6)]
    turned = long[1][::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = list(enumerate([*long, *long[:3], *long[:2], long[0], turned, long[2][:700] + "x" + long[2][700:], "", None, "ACGT"]))
    # one id twice: texts decide
    rows += [(3, long[4]), (3, long[5])]
    df = spark.createDataFrame(rows, "read_id long, seq string").repartition(3)
    found = inflate.read_dictionary(df, 15, 4, 31)
    want = inflate.dictionary(inflate.sightings(df, 15, 4, 31))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.where("confirmed").count() > 50 and found.schema == want.schema
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    texts = [b"A", b"AA", b"AAAA", b"AAAAA", b"AC", b"ACN", b"T", b"NNA", b""]
    packed = [next(inflate.packed_texts(x + b"G", np.array([0]), np.array([len(x) - 1]), np.array([False]))) for x in texts]
    assert [x.encode() for x in inflate.unpacked_texts(packed).to_pylist()] == texts and [x for _, x in sorted(zip(packed, texts, strict=True))] == sorted(texts)


def test_rounds_of_copying_and_ranking_leave_no_bitmaps(spark, monkeypatch):
    from helixframe.operators import contract, edit, sieve

    made, gone, real = [], [], sieve.sieve

    def counting(keys):
        out = real(keys)
        destroy = out.destroy
        made.append(out)
        out.destroy = lambda: (gone.append(out), destroy())
        return out

    for module in (sieve, edit, contract):
        monkeypatch.setattr(module, "sieve", counting)
    links = [(0, 1, 2, 0), (1, 1, 2, 0), (2, 1, 3, 0), (3, 1, 4, 0), (3, 1, 5, 0)]
    edges = spark.createDataFrame([y for a, ea, b, eb in links for y in ((a, ea, b, eb), (b, eb, a, ea))], "a long, ea int, b long, eb int")
    segments = spark.createDataFrame([(i, 50, 10.0) for i in range(6)], "seg long, length int, coverage double")
    whole, _ = edit.duplicated(segments, edges, lambda s, e: edit.exclusive_ends(s, e, short=100))
    assert whole.count() > 6 and len(made) >= 2
    line = [(i, 1, i + 1, 0) for i in range(20)]
    edges = spark.createDataFrame([y for a, ea, b, eb in line for y in ((a, ea, b, eb), (b, eb, a, ea))], "a long, ea int, b long, eb int")
    before = len(made)
    assert {r["idx"] for r in contract.chains(spark.createDataFrame([(i,) for i in range(21)], "seg long"), edges, small=0).collect()} == set(range(21))
    assert len(made) > before and len(gone) == len(made)
