"""File formats, streams and the catalogue."""

import gzip
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.operators import loop
from helixframe.plans import assembly, catalogue
from helixframe.sources import formats
from helixframe.streaming.reduce import reduce_documents

GFA = "H\tVN:Z:1.0\nS\ta\tACGTAC\tDP:f:3.5\nS\tb\tGGTT\tKC:i:8\nS\tc\t*\tLN:i:70\tkm:f:2\nL\ta\t+\tb\t-\t2M\nL\tb\t+\ta\t-\t2M\nL\ta\t+\tzz\t+\t*\nL\tb\t+\tc\t+\t*\n"


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">r1\nACGT\nAC\n>false1\nAA\n>r2\nGG\n")
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(">r1\nACGT\n>r2\nGG\n")
    (tmp_path / "x.fq").write_text("@q1\nACGT\n+\n@III\n@q2\nGG\n+\nII\n")
    assert {tuple(r) for r in formats.read_reads(spark, f"{tmp_path}/x.fa").collect()} == {("r1", "ACGTAC"), ("r2", "GG")}
    assert {tuple(r) for r in formats.read_reads(spark, f"{tmp_path}/x.fa.gz").collect()} == {("r1", "ACGT"), ("r2", "GG")}
    assert {tuple(r) for r in formats.read_reads(spark, f"{tmp_path}/x.fq").collect()} == {("q1", "ACGT"), ("q2", "GG")}


def test_fastq_in_many_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        n = rng.randint(1, 90)
        rows.append((f"r{i} x", "".join(rng.choice("ACGT") for _ in range(n)), rng.choice(["@", "I", "+"]) + "".join(rng.choice("@+I#") for _ in range(n - 1))))
    (tmp_path / "x.fq").write_text("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in rows))
    for size in ("200", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = formats.read_fastq(spark, f"{tmp_path}/x.fq")
            assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "e.fq").write_text("@a\nAC\n+\nII\n@b\nGT\n+\n")
    assert {tuple(r) for r in formats.read_fastq(spark, f"{tmp_path}/e.fq").collect()} == {("a", "AC", "II"), ("b", "GT", None)}


def test_exports_put_the_longest_first(spark, tmp_path):
    segments = spark.createDataFrame([("a", "ACG", 3, 1.0), ("b", "ACGTAC", 6, 2.0), ("c", "ACG", 3, 3.0)], "name string, seq string, length int, coverage double")
    edges = spark.createDataFrame([("a", 1, "b", 0, 2), ("b", 0, "a", 1, 2)], "a string, ea int, b string, eb int, overlap int")
    names = formats.export_gfa(segments, edges, f"{tmp_path}/gfa", "super_")
    assert {tuple(r) for r in names.collect()} == {("b", "super_0"), ("a", "super_1"), ("c", "super_2")}
    lines = [x for p in sorted((tmp_path / "gfa").glob("part*")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[1] for x in lines] == ["super_0", "super_1", "super_2", "super_0"] and lines[-1] == "L\tsuper_0\t-\tsuper_1\t-\t2M"
    formats.export_fasta(segments, f"{tmp_path}/fa")
    text = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part*")))
    assert text == ">b\nACGTAC\n>a\nACG\n>c\nACG\n"
    parts = spark.createDataFrame([("x", 0, "AACC", True, None), ("x", 1, "AAGG", False, 2)], "name string, idx int, seq string, fwd boolean, overlap int")
    assert tuple(formats.merged_parts(parts).first()) == ("x", "AACCTT", 6)
    assert formats.by_name(segments, names.where("was = 'c'").select(F.col("was").alias("name"))).first()["coverage"] == 3.0


def test_gfa_round_trip(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA)
    segments, edges = formats.read_gfa(spark, f"{tmp_path}/g.gfa")
    assert {(r["name"], r["length"], r["coverage"]) for r in segments.collect()} == {("a", 6, 3.5), ("b", 4, 2.0), ("c", 70, 2.0)}
    assert {(r["a"], r["ea"], r["b"], r["eb"], r["overlap"]) for r in edges.collect()} == {("a", 1, "b", 1, 2), ("b", 1, "a", 1, 2), ("b", 1, "c", 0, None), ("c", 0, "b", 1, None)}
    formats.write_gfa(segments, edges, f"{tmp_path}/out")
    lines = [x for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert [x[0] for x in lines] == ["S", "S", "S", "L", "L"]
    again, links = formats.read_gfa(spark, f"{tmp_path}/out")
    assert links.count() == 4 and again.count() == 3
    formats.gfa_to_fasta(spark, f"{tmp_path}/g.gfa", f"{tmp_path}/fasta")
    assert {r["name"] for r in formats.read_fasta(spark, f"{tmp_path}/fasta").collect()} == {"a", "b", "c"}


def test_unitig_fasta_and_fastg(spark, tmp_path):
    (tmp_path / "u.fa").write_text(">0 LN:i:4 KC:i:4 km:f:2.0 L:+:1:- L:-:0:+\nACGT\n>1 LN:i:3 KC:i:3 km:f:1.0 L:+:0:-\nTTT\n")
    segments, links = formats.read_unitigs(spark, f"{tmp_path}/u.fa", 3)
    assert {(r["name"], r["coverage"]) for r in segments.collect()} == {("0", 2.0), ("1", 1.0)} and links.count() == 3
    assert formats.read_unitigs(spark, f"{tmp_path}/u.fa", 3, single_directed=True)[1].where("a = '0'").count() >= 1
    (tmp_path / "x.fastg").write_text(">n1:n2,n3';\nACGT\n>n2;\nGG\n>n3:n1';\nCC\n")
    segments, links = formats.read_fastg(spark, f"{tmp_path}/x.fastg")
    assert segments.count() == 3 and {(r["a"], r["ea"], r["b"], r["eb"]) for r in links.collect()} == {("n1", 1, "n2", 0), ("n1", 1, "n3", 1), ("n3", 1, "n1", 1)}


def test_coverage_of_a_graph_may_be_required(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("S\ta\tACGT\trc:f:3\nS\tb\tAC\n")
    path = f"{tmp_path}/g.gfa"
    assert {(r["name"], r["coverage"]) for r in formats.read_gfa(spark, path)[0].collect()} == {("a", 3.0), ("b", 0.0)}
    assert {(r["name"], r["coverage"]) for r in formats.read_gfa(spark, path, extra=2.5)[0].collect()} == {("a", 1.0), ("b", 1.0)}
    with pytest.raises(Exception, match="segment without coverage: b"):
        formats.read_gfa(spark, path, covered=True)[0].collect()


def test_scratch_is_deleted(spark):
    with loop.scratch(spark) as folder:
        kept = loop.written(spark.range(5), "x")
        assert kept.count() == 5 and folder in kept.inputFiles()[0]  # the folder may be set without a scheme
    assert not Path(folder.removeprefix("file://")).exists()


def test_gaf(spark, tmp_path):
    walks = spark.createDataFrame([("r", 0, 100, ">1<2", 90)], "name string, idx int, read_length int, path string, path_length int")
    line = formats.gaf_lines(walks).first()["line"]
    assert line == "r_0\t100\t0\t100\t+\t>1<2\t90\t0\t90\t90\t90\t255"
    (tmp_path / "w.gaf").write_text(line + "\n")
    assert tuple(formats.read_gaf(spark, f"{tmp_path}/w.gaf").first()) == ("r_0", ">1<2")


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    batch = {tuple(r) for r in catalogue.QUERIES["msr_reduce"](spark, sf).collect()}
    assert {tuple(r) for r in reduce_documents(spark, sf, 101, 20).collect()} == batch


def test_parameters():
    assert assembly.Parameters(order=100).order == 99
    with pytest.raises(ValueError, match="increase"):
        assembly.Parameters(ks=(21, 17))


def test_entry_and_catalogue(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def block_gzip(data, size):
    """Gzip members of ``size`` plain bytes each with their own size in the header, and an empty last one."""
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        raw = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = raw.compress(data[at : at + size]) + raw.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (6).to_bytes(2, "little") + b"BC" + (2).to_bytes(2, "little") + (len(body) + 25).to_bytes(2, "little")
        out += head + body + zlib.crc32(data[at : at + size]).to_bytes(4, "little") + len(data[at : at + size]).to_bytes(4, "little")
    return out


@pytest.mark.parametrize("kind", ["plain", "blocks", "gzip"])
@pytest.mark.parametrize("quality", [True, False])
def test_planned_splits_read_each_record_once(spark, tmp_path, kind, quality):
    from helixframe.sources.reads import load_reads

    rng = random.Random(90)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 5, 60, 200])))) for i in range(150)] + [("false1", "ACGT")]
    if quality:
        text = "".join(f"@{n}\n{s}\n+{n if i % 3 else ''}\n{'@+I'[i % 3] * len(s)}\n" for i, (n, s) in enumerate(rows))
    else:
        text = "".join(f">{n}\n" + "".join(s[k : k + 50] + "\n" for k in range(0, len(s), 50)) for n, s in rows).removesuffix("\n")
    data = text.encode()
    body = {"plain": lambda: data, "gzip": lambda: gzip.compress(data), "blocks": lambda: block_gzip(data, 700)}[kind]()
    path = tmp_path / f"reads.{'fq' if quality else 'fa'}{'' if kind == 'plain' else '.gz'}"
    path.write_bytes(body)
    for split in (700, 1 << 20):
        got = load_reads(spark, str(path), split)
        tasks = got.rdd.getNumPartitions()
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows[:-1])
        assert tasks == 1 if kind == "gzip" or split == 1 << 20 else tasks > 3
    assert sorted(tuple(r) for r in formats.read_reads(spark, str(path)).collect()) == sorted(rows[:-1])


def test_a_record_that_starts_with_a_block_is_read_once(spark, tmp_path):
    from helixframe.sources.reads import load_reads

    # every record is 32 bytes long, as every block is
    records = [f"@read{i:05d}\nACGTACGTA\n+\nIIIIIIII@\n" for i in range(100)]
    assert {len(r) for r in records} == {33}
    (tmp_path / "x.fastq.gz").write_bytes(block_gzip("".join(records).encode(), 33))
    for split in (33, 50, 400):
        assert sorted(r["name"] for r in load_reads(spark, str(tmp_path), split).collect()) == [f"read{i:05d}" for i in range(100)]


def test_a_store_reads_few_rows_for_a_few_names(spark, tmp_path):
    from helixframe.sources import store

    n = 40_000
    segments = spark.range(n).select(F.format_string("s%06d", "id").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("seq"), (F.col("id") % 90).cast("int").alias("length"))
    edges = spark.range(n - 1).select(F.format_string("s%06d", "id").alias("a"), F.lit(1).alias("ea"), F.format_string("s%06d", F.col("id") + 1).alias("b"), F.lit(0).alias("eb"))
    path = str(tmp_path / "store")
    store.write_store(segments, edges, path, **{"parquet.block.size": "200000"})

    def scanned(df):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        return rows, scan.metrics().apply("numOutputRows").value()

    names = ["s000007", "s031234", "nowhere"]
    rows, seen = scanned(store.fetched(spark, path, names))
    assert sorted(r["name"] for r in rows) == names[:2] and all(len(r["seq"]) == 64 for r in rows) and seen <= 2 * 2000
    rows, seen = scanned(store.fetched(spark, path, ["nowhere"]))
    assert not rows and seen <= 2000
    links, _ = scanned(store.fetched(spark, path, names, "links"))
    assert {(r["a"], r["b"]) for r in links} == {("s000007", "s000008"), ("s031234", "s031235")}
    assert store.fetched(spark, path, spark.createDataFrame([(x,) for x in names], "name string"), "topology").count() == 2
    many = segments.where("length < 45").select("name")
    assert store.fetched(spark, path, many).count() == many.count() > store.FEW


def test_contigs_are_checked_against_a_reference_graph(spark, tmp_path):
    rng = random.Random(91)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rc = lambda t: t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    refs = [text(300), text(120)]
    (tmp_path / "ref.gfa").write_text("".join(f"S\ts{i}\t{x}\n" for i, x in enumerate([*refs, refs[0], "*"])) + "L\ts0\t+\ts1\t+\t0M\n")
    contigs = [refs[0][40:200], rc(refs[1]), text(90), refs[0][250:] + refs[1][:60], rc(refs[0][5:20]), "*"]
    df = spark.createDataFrame(list(enumerate(contigs)), "seg long, seq string")
    assert {r["seg"] for r in assembly.missing_from(df, f"{tmp_path}/ref.gfa").collect()} == {2, 3, 5}
