"""Graph operators on micro graphs, with outcomes derived from their rules, and on random ones against plain versions."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from helixframe.operators import contract, edit, graph, paths, untangle, walks

LINK = {"+": 1, "-": 0}


def graph_of(spark, segments, links):
    """Segments ``name: (length, coverage)`` and links like ``a+ b-``."""
    ids = {n: i for i, n in enumerate(segments)}
    segs = spark.createDataFrame([(ids[n], x, float(c)) for n, (x, c) in segments.items()], "seg long, length int, coverage double")
    rows = set()
    for link in links:
        x, y = link.split()
        e = (ids[x[:-1]], LINK[x[-1]], ids[y[:-1]], 1 - LINK[y[-1]])
        rows |= {e, (e[2], e[3], e[0], e[1])}
    return ids, segs, spark.createDataFrame(sorted(rows), "a long, ea int, b long, eb int")


def names(ids, rows):
    back = {i: n for n, i in ids.items()}
    return {back[r] for r in rows}


def test_merge_chain(spark):
    ids, s, e = graph_of(spark, {"a": (100, 10), "b": (50, 20), "c": (100, 10)}, ["a+ b+", "b+ c+"])
    whole, links = contract.merged(s, e)
    assert [tuple(r) for r in whole.select("seg", "length", "coverage", "parts").collect()] == [(0, 250, 12.0, 3)]
    assert links.count() == 0
    seqs = spark.createDataFrame([(0, "AACCGG"), (1, "GGTTT"), (2, "TTAC")], "seg long, seq string")
    assert contract.spelled(contract.chains(s, e), seqs, 2).first()["seq"] == "AACCGGTTTAC"


def test_merge_reversed_part(spark):
    ids, s, e = graph_of(spark, {"a": (100, 10), "b": (50, 20)}, ["a+ b-"])
    seqs = spark.createDataFrame([(0, "AACCGG"), (1, "TTCC")], "seg long, seq string")
    assert contract.spelled(contract.chains(s, e), seqs, 2).first()["seq"] == "AACCGGAA"


def test_merge_ring(spark):
    ids, s, e = graph_of(spark, {"a": (60, 5), "b": (60, 5)}, ["a+ b+", "b+ a+"])
    whole, links = contract.merged(s, e)
    assert [(r["seg"], r["parts"]) for r in whole.collect()] == [(0, 2)]
    assert {tuple(r) for r in links.select("a", "ea", "b", "eb").collect()} == {(0, 1, 0, 0), (0, 0, 0, 1)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_rings_of_any_size(spark, n):
    ids, s, e = graph_of(spark, {str(i): (10, 1) for i in range(n)}, [f"{i}+ {(i + 1) % n}+" for i in range(n)])
    placed = sorted((r["idx"], r["seg"]) for r in contract.chains(s, e).collect())
    assert placed == [(i, i) for i in range(n)]


def test_long_chain_with_mixed_orientations(spark):
    rng = random.Random(1)
    signs = [rng.choice("+-") for _ in range(37)]
    ids, s, e = graph_of(spark, {str(i): (10, 1) for i in range(37)}, [f"{i}{signs[i]} {i + 1}{signs[i + 1]}" for i in range(36)])
    placed = sorted((r["idx"], r["seg"], r["fwd"]) for r in contract.chains(s, e).collect())
    assert placed == [(i, i, signs[i] == "+") for i in range(37)]


def test_tip(spark):
    ids, s, e = graph_of(spark, {"a": (500, 30), "b": (30, 2), "c": (500, 30)}, ["a+ b+", "a+ c+"])
    removed, cut = graph.trimmed(s, e, 5, 42)
    assert names(ids, [r[0] for r in removed.collect()]) == {"b"}


def test_detach(spark):
    ids, s, e = graph_of(spark, {"a": (500, 30), "b": (500, 10), "c": (500, 30)}, ["a+ b+", "a+ c+"])
    removed, cut = graph.trimmed(s, e, 5, 42)
    assert removed.count() == 0 and [(r["a"], r["b"]) for r in cut.collect()] == [(0, 1)]


def test_coverage_one_bubble(spark):
    shape = {"a": (500, 30), "b": (41, 1), "c": (41, 29), "d": (500, 30)}
    ids, s, e = graph_of(spark, shape, ["a+ b+", "a+ c+", "b+ d+", "c+ d+"])
    removed, _ = graph.trimmed(s, e, 5, 42)
    assert names(ids, [r[0] for r in removed.collect()]) == {"b"}
    assert {tuple(r) for r in graph.bubbles(s, e).collect()} == {(1, 2), (2, 1)}


def test_weak_bubble_is_popped_and_its_sibling_rescued(spark):
    shape = {"a": (500, 30), "b": (41, 3), "c": (41, 29), "d": (500, 30)}
    ids, s, e = graph_of(spark, shape, ["a+ b+", "a+ c+", "b+ d+", "c+ d+"])
    kept = paths.pop_and_shave(s, e, 5, 43, 21)
    assert names(ids, [r[0] for r in kept.collect()]) == {"a", "c", "d"}


def test_shave(spark):
    ids, s, e = graph_of(spark, {"x": (100, 1), "a": (10, 1), "y": (100, 1), "b": (10, 1)}, ["x+ a+", "a+ y+", "x+ b+"])
    kept, links = graph.shaved(s, e, 50)
    assert names(ids, [r["seg"] for r in kept.collect()]) == {"x", "a", "y"} and links.count() == 4


def test_duplicate(spark):
    for coverage, n in ((20, 2), (15, 0)):
        ids, s, e = graph_of(spark, {"s": (100, coverage), "x": (100, 10), "y": (100, 9)}, ["x+ s+", "y+ s+"])
        got = sorted(r["coverage"] for r in edit.copies(s, e, edit.shared_ends(s, e)).collect())
        assert got == pytest.approx([20 * 9 / 19, 20 * 10 / 19][:n] if n else [])


def test_pop_bubbles_keeps_the_stronger_walk(spark):
    shape = {"a": (500, 30), "b": (20, 3), "c": (20, 29), "d": (500, 30)}
    ids, s, e = graph_of(spark, shape, ["a+ b+", "a+ c+", "b+ d+", "c+ d+"])
    cut = {(r["a"], r["b"]) for r in paths.popped(s, e, 300).collect()}
    assert cut == {(0, 1), (1, 3)}


def test_pop_bubbles_of_any_number_of_walks(spark):
    # 60 parallel pieces, and five bubbles in a row: 4 ** 5 walks
    shape = {"a": (500, 30), "z": (500, 30)} | {f"m{i}": (20, i + 1) for i in range(60)}
    links = [f"a+ m{i}+" for i in range(60)] + [f"m{i}+ z+" for i in range(60)]
    ids, s, e = graph_of(spark, shape, links)
    cut = {(r["a"], r["b"]) for r in paths.popped(s, e, 300).collect()}
    assert cut == {tuple(sorted((ids[x], ids[f"m{i}"]))) for x in "az" for i in range(59)}
    shape, links = {"a": (500, 30), "z": (500, 30)}, []
    joints = ["a", "j0", "j1", "j2", "j3", "z"]
    shape |= {j: (1, 30) for j in joints[1:-1]}
    for k in range(5):
        shape |= {f"p{k}{i}": (10 + i, 5 + (i + k) % 4) for i in range(4)}
        links += [x for i in range(4) for x in (f"{joints[k]}+ p{k}{i}+", f"p{k}{i}+ {joints[k + 1]}+")]
    ids, s, e = graph_of(spark, shape, links)
    cut = {(r["a"], r["b"]) for r in paths.popped(s, e, 300).collect()}
    ways = [w for w in itertools.product(range(4), repeat=5)]
    mean = lambda w: sum(shape[f"p{k}{i}"][0] * shape[f"p{k}{i}"][1] for k, i in enumerate(w)) + 15120
    total = lambda w: sum(shape[f"p{k}{i}"][0] for k, i in enumerate(w)) + 504
    best = max(ways, key=lambda w: mean(w) / total(w))
    assert cut == {tuple(sorted((ids[x], ids[f"p{k}{i}"]))) for k in range(5) for i in range(4) if i != best[k] for x in (joints[k], joints[k + 1])}


def plain_popped(shape, at, longest):
    """The links that go, by enumerating all walks; ``at`` leads from (segment, end) to segments and the ends they are entered by."""
    budget = longest // 2

    def walks(i, end, left, weight, path):
        for b, eb in at.get((i, end), []):
            x, c = shape[b]
            link = (*path, (i, end, b, eb))
            if left - x > 0:
                yield from walks(b, 1 - eb, left - x, weight - x * c, link)
            else:
                yield (weight - x * c) / (budget - left + x), [p[2] for p in link], [p[3] for p in link], link

    found = lambda i, end: list(walks(i, end, budget, 0.0, ()))
    reached = lambda ways: {(w[1][-1], 1 - w[2][-1]) for w in ways}
    turned = lambda a, ea, b, eb: min((a, ea, b, eb), (b, eb, a, ea))
    bad, good, back = set(), set(), 0
    for i, end in [(i, end) for i, (x, _) in enumerate(shape) if x > longest for end in (0, 1)]:
        ways = found(i, end)
        if len(ways) < 2 or len(reached(ways)) > 1 or ways[0][1][-1] == i:
            continue
        ((last, last_end),) = reached(ways)
        if reached(found(last, 1 - last_end)) == {(i, 1 - end)}:
            back += shape[last][0] <= longest
            bad |= {turned(*x) for w in ways for x in w[3]}
            good |= {turned(*x) for x in min(ways)[3]}
    return bad - good, back


def test_popped_bubbles_equal_a_plain_version_and_are_walked_once(spark, monkeypatch):
    rng = random.Random(7)
    shape, links = {"j0": (500, 10)}, []
    for k in range(40):
        shape[f"j{k + 1}"] = (rng.choice((500, 500, 200, 40, 1)), rng.randrange(5, 20))
        for i in range(rng.randrange(1, 5)):
            shape[f"m{k}{i}"] = (rng.choice((10, 20, 20, 60)), rng.randrange(1, 9))
            links.append(f"j{k}+ m{k}{i}{(sign := rng.choice('+-'))}")
            if rng.random() < 0.97:
                links.append(f"m{k}{i}{sign} j{k + 1}+")
    ids, s, e = graph_of(spark, shape, links)
    at = {}
    for r in e.collect():
        at.setdefault((r["a"], r["ea"]), []).append((r["b"], r["eb"]))
    want, back = plain_popped(list(shape.values()), at, 300)
    assert {tuple(r) for r in paths.popped(s, e, 300).collect()} == want and len(want) > 20 and back
    # parallel ways between long segments: of each, only the second of two moves from both ends is written, and no way back
    shape = {f"j{k}": (500, 10) for k in range(21)} | {f"m{k}{i}": (20, 1 + i) for k in range(20) for i in range(3)}
    links = [x for k in range(20) for i in range(3) for x in (f"j{k}+ m{k}{i}+", f"m{k}{i}+ j{k + 1}+")]
    rows, real = [], paths.written

    def counting(frame, tag):
        out = real(frame, tag)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(paths, "written", counting)
    ids, s, e = graph_of(spark, shape, links)
    assert paths.popped(s, e, 300).count() == 80
    assert [n for tag, n in rows if tag == "spread"] == [120]


def test_walk_support(spark):
    # walks to the right of s: [x, y] twice, [x], [x, z]
    rows = []
    for r, w in enumerate([[0, 1, 2], [0, 1, 2], [0, 1], [0, 1, 3]]):
        rows += [(r, i, x, True) for i, x in enumerate(w)]
    steps = spark.createDataFrame(rows, "read_id long, idx int, seg long, fwd boolean")
    got = {r["prefix"]: (r["support"], r["against"]) for r in walks.prefix_support(steps).where("seg = 0 and side = 1").collect()}
    assert got == {">1": (4, 0), ">1>2": (2, 1), ">1>3": (1, 2)}
    assert {r["path"] for r in walks.maximal(steps).where("seg = 0").collect()} == {">1>2", ">1>3"}


def test_walk_strings_round_trip(spark):
    rows = [(1, 0, 12, True), (1, 1, 7, False), (2, 0, 5, False)]
    steps = spark.createDataFrame(rows, "read_id long, idx int, seg long, fwd boolean")
    strings = walks.path_strings(steps)
    assert {r["read_id"]: r["path"] for r in strings.collect()} == {1: ">12<7", 2: "<5"}
    assert sorted(tuple(r) for r in walks.parsed(strings).collect()) == rows


def test_bridges_and_unrepresented_walks(spark):
    rows = []
    for r in range(3):
        rows += [(r, i, x, True) for i, x in enumerate([0, 1, 2, 3])]
    steps = spark.createDataFrame(rows, "read_id long, idx int, seg long, fwd boolean")
    segments = spark.createDataFrame([(i, 10, 3.0) for i in range(4)], "seg long, length int, coverage double")
    agreed = walks.consensus(steps, segments)
    assert {r["seg"]: r["haploid"] for r in agreed.collect()} == dict.fromkeys(range(4), True)
    built = walks.bridges(agreed)
    assert {(r["seg"], r["target"], r["path"]) for r in built.collect()} == {(0, 1, ">1"), (1, 2, ">2"), (2, 3, ">3")}
    # each inner segment has one side that a bridge holds; without bridges both count
    assert walks.unrepresented(walks.strong(steps), built).count() == 0
    assert {(r["seg"], r["side"]) for r in walks.unrepresented(walks.strong(steps), built.where("false")).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_unitigs_hold_each_solid_kmer_once(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [(i, genome[i * 40 : i * 40 + 120]) for i in range(8)] * 2
    df = spark.createDataFrame(reads, "read_id long, seq string")
    from helixframe.plans.assembly import spelled_unitigs

    comp = str.maketrans("ACGT", "TGCA")
    canon = lambda w: min(w, w.translate(comp)[::-1])
    solid = {canon(genome[i : i + 15]) for i in range(400 - 14)}
    got = [r["seq"] for r in spelled_unitigs(df, 15, 2).collect()]
    spelled = [canon(s[i : i + 15]) for s in got for i in range(len(s) - 14)]
    assert sorted(spelled) == sorted(solid)
    assert len(got) == 1 and (got[0] == genome or got[0].translate(comp)[::-1] == genome)


def plain_unitigs(reads, k, least):
    """Maximal unbranched runs of solid k-mers as the smaller of both strands, walked base by base."""
    count = {}
    for read in reads:
        for i in range(len(read) - k + 1):
            w = min(read[i : i + k], rc(read[i : i + k]))
            count[w] = count.get(w, 0) + 1
    solid = {w for w, n in count.items() if n >= least}
    after = lambda w: [w[1:] + b for b in "ACGT" if min(w[1:] + b, rc(w[1:] + b)) in solid]
    seen, out = set(), []
    for w in sorted(solid):
        if w in seen:
            continue
        text, members = w, {w}
        for _ in range(2):  # forward, then the other way
            while True:
                end = text[-k:]
                nxt = after(end)
                if len(nxt) != 1 or len(after(rc(nxt[0]))) != 1 or min(nxt[0], rc(nxt[0])) in members:
                    break
                members.add(min(nxt[0], rc(nxt[0])))
                text += nxt[0][-1]
            text = rc(text)
        seen |= members
        out.append((min(text, rc(text)), sum(count[m] for m in members) / len(members)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_unitigs_equal_a_plain_version(spark, seed):
    from helixframe.plans import assembly

    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    other = genome[:140] + rng.choice("ACGT") + genome[141:]
    reads = [x[i : i + 60] for x in (genome, other) for i in range(0, 240, 7)]
    reads += [rc(x) for x in reads[::3]] + ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = sorted((min(r["seq"], rc(r["seq"])), r["coverage"]) for r in assembly.unitig_graph(df, 11, 2)[0].collect())
    want = plain_unitigs(reads, 11, 2)
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want])
    twice = reads + [x for x, _ in want if len(x) >= 15] * 2
    got = sorted(min(r["seq"], rc(r["seq"])) for r in assembly.iterative(df, (11, 15), 2)[0].collect())
    assert got == [x for x, _ in plain_unitigs(twice, 15, 2)]


@pytest.mark.parametrize(("seed", "k"), [(0, 5), (1, 11), (2, 25), (3, 31)])
def test_unitig_coverage_equals_a_plain_version_and_writes_no_kmers(spark, monkeypatch, seed, k):
    from helixframe.operators import longmers
    from helixframe.plans import catalogue

    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome, ring = text(900), text(300)
    sources = (genome, genome[:400] + "A" + genome[401:], genome[200:500] + text(200) + genome[500:700], ring + ring[: k + 90])
    reads = [x[i : i + k + 50] for x in sources for i in range(0, len(x) - k - 40, 7)]
    reads += [rc(x) for x in reads[::3]] + ["", None, "A" * (k + 99), "ACGT", text(k + 5)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").repartition(3)
    rows = []
    real = longmers.written

    def counting(frame, tag):
        out = real(frame, tag)
        rows.append(out.count())
        return out

    monkeypatch.setattr(longmers, "written", counting)
    monkeypatch.setattr(catalogue.R, "reads", lambda spark, sf_dir: df)
    frame = catalogue.unitig_build(spark, "") if k == 25 else longmers.unitig_coverage(df, k, 2)
    got = sorted((r["seg"], r["n_kmers"], round(r["coverage"], 9)) for r in frame.collect())

    def shape(seq, coverage):
        kmers = [min(w, rc(w)) for w in (seq[i : i + k] for i in range(len(seq) - k + 1))]
        ringed = seq[: k - 1] == seq[-(k - 1) :] and len(seq) > k
        code = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
        return min(map(code, kmers if ringed else (kmers[0], kmers[-1]))), len(kmers), round(coverage, 9)

    want = sorted(shape(*x) for x in plain_unitigs([x for x in reads if x], k, 2))
    assert got == want
    # names of minimizers aside, what is written are pieces of unitigs; short k-mers hardly share minimizers
    assert k < 25 or max(rows[1:]) < sum(x[1] for x in want) / 2


@pytest.mark.parametrize(("seed", "k"), [(0, 5), (1, 11), (2, 33), (3, 101)])
def test_unitigs_of_any_length_equal_a_plain_version(spark, seed, k):
    from helixframe.operators import longmers

    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome, ring = text(900), text(300)
    other = genome[:400] + "A" + genome[401:]
    sources = (genome, other, genome[200:500] + text(200) + genome[500:700], ring + ring[: k + 90])
    reads = [x[i : i + k + 50] for x in sources for i in range(0, len(x) - k - 40, 7)]
    reads += [rc(x) for x in reads[::3]] + ["", None, "A" * (k + 99), "ACGT", text(k + 5)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").repartition(3)
    reads = [x for x in reads if x]
    segments, edges = longmers.unitigs(df, k, 2)
    got = segments.collect()
    canon = lambda w: min(w, rc(w))
    # a ring may begin anywhere
    ringed = lambda s: s[: k - 1] == s[-(k - 1) :] and len(s) > k
    named = lambda s: (len(s), *sorted(canon(s[i : i + k]) for i in range(len(s) - k + 1))) if ringed(s) else s
    want = plain_unitigs(reads, k, 2)
    key = lambda x: (str(x[0]), x[1])
    assert sorted([(named(r["seq"]), round(r["coverage"], 6)) for r in got], key=key) == sorted([(named(a), round(b, 6)) for a, b in want], key=key)
    assert (k == 5 or any(ringed(a) for a, _ in want)) and all(r["seq"] == canon(r["seq"]) and r["length"] == len(r["seq"]) for r in got)
    ends = [(r["seg"], e, (r["seq"] if e else rc(r["seq"]))[-(k - 1) :]) for r in got for e in (0, 1)]
    links = {(a, ea, b, eb) for a, ea, w in ends for b, eb, v in ends if w == rc(v)}
    assert {(r["a"], r["ea"], r["b"], r["eb"]) for r in edges.collect()} == links
    for least in (1, 3):
        count = {}
        for x in reads:
            for i in range(len(x) - k + 1):
                count[canon(x[i : i + k])] = count.get(canon(x[i : i + k]), 0) + 1
        assert {r["kmer"]: r["n"] for r in longmers.counts(df, k, least).collect()} == {w: n for w, n in count.items() if n >= least}


def test_hot_minimizers_are_dealt_by_kmer(spark):
    from helixframe.functions.sequence import codes
    from helixframe.operators import longmers

    rng = random.Random(81)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    # one word of the smallest hash in all windows of all reads
    motif = min((text(11) for _ in range(5000)), key=lambda x: longmers.minimizers(codes(x.encode()), 11, 11)[0])
    reads = [text(19) + motif + text(19) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    assert longmers.pieces(df, 31).select("bucket").distinct().count() == 16
    want = {}
    for x in reads:
        for i in range(len(x) - 30):
            want[min(x[i : i + 31], rc(x[i : i + 31]))] = want.get(min(x[i : i + 31], rc(x[i : i + 31])), 0) + 1
    assert {r["kmer"]: r["n"] for r in longmers.counts(df, 31).collect()} == want
    assert sorted(min(r["seq"], rc(r["seq"])) for r in longmers.unitigs(df, 31, 1)[0].collect()) == [a for a, _ in plain_unitigs(reads, 31, 1)]
    assert longmers.counts(df.where("false"), 31).count() == 0 and longmers.unitigs(df.where("false"), 31, 1)[0].count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_chains_in_one_task_and_by_rounds_are_the_same(spark, seed):
    rng = random.Random(seed)
    n, links, at = 120, [], 0
    while at < n:
        size = rng.choice([1, 2, 3, 8, 20])
        line = [(i, rng.random() < 0.5) for i in range(at, min(at + size, n))]
        rng.shuffle(line)
        pairs = list(zip(line, line[1:]))
        if rng.random() < 0.4 and len(line) > 1:
            pairs.append((line[-1], line[0]))
        links += [f"{a}{'+' if f else '-'} {b}{'+' if g else '-'}" for (a, f), (b, g) in pairs]
        at += size
    links += [f"{rng.randrange(n)}+ {rng.randrange(n)}-" for _ in range(6)]
    ids, s, e = graph_of(spark, {str(i): (10, 1) for i in range(n)}, links)
    one, many = (sorted(tuple(r) for r in contract.chains(s, e, small=k).select("seg", "chain", "idx", "fwd", "ring").collect()) for k in (10_000, 0))
    assert one == many and len(one) == n and any(r[4] for r in one) == any(r[4] for r in many)


def test_rounds_write_what_is_still_open(spark, monkeypatch):
    sizes = []
    keep = contract.written

    def counted(df, tag):
        out = keep(df, tag)
        if tag == "chains":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(contract, "written", counted)
    names = {str(i): (10, 1) for i in range(400)}
    line = [f"{i}+ {i + 1}+" for i in range(199)]
    ring = [f"{i}+ {200 + (i - 199) % 37}+" for i in range(200, 237)]
    short = [f"{i}+ {i + 1}-" for i in range(240, 398, 2)]
    ids, s, e = graph_of(spark, names, line + ring + short)
    placed = {r["seg"]: r for r in contract.chains(s, e, small=0).collect()}
    assert len(placed) == 400 and [placed[i]["idx"] for i in range(200)] == list(range(200))
    assert sorted(placed[i]["idx"] for i in range(200, 237)) == list(range(37)) and all(placed[i]["ring"] for i in range(200, 237))
    assert sizes[0] == 800 and len(sizes) <= 10 and all(b <= a for a, b in zip(sizes, sizes[1:]))
    assert sizes[1] < 650 and sizes[-1] < 300


def test_short_contigs_are_found_in_references(spark):
    from helixframe.operators import containment

    reads = ["ACGTACGTTTGACA" * 4, "GGGTCAAACGTA", None]
    contigs = ["GTTTGAC", "TCAAACG", "", "ACGTACGTTTGACA" * 3, "CCCCC"]
    got = {r["seg"]: r["n_in"] for r in containment.containment(spark.createDataFrame(list(enumerate(contigs)), "seg long, seq string"), spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")).collect()}
    held = lambda c: sum(c in r or rc(c) in r for r in reads if r is not None)
    assert got == {i: held(c) for i, c in enumerate(contigs)}


def test_trimmed_overlaps(spark):
    ids, s, e = graph_of(spark, {"a": (100, 1), "b": (100, 1), "c": (100, 1)}, ["a+ b+", "a+ c+"])
    lost, left = edit.trimmed_overlaps(s, e.withColumn("overlap", F.when(F.col("a") + F.col("b") == 1, 20).otherwise(30)))
    assert {r["seg"]: (r["left"], r["right"]) for r in lost.collect()} == {0: (0, 20), 1: (0, 0), 2: (10, 0)}
    assert {r["overlap"] for r in left.collect()} == {0}


def random_graph(spark, seed, n=40, m=55):
    rng = random.Random(seed)
    shape = {str(i): (rng.choice([5, 20, 60, 150]), rng.choice([1, 2, 3, 8, 30, 200])) for i in range(n)}
    links = [f"{rng.randrange(n)}{rng.choice('+-')} {rng.randrange(n)}{rng.choice('+-')}" for _ in range(m)]
    ids, s, e = graph_of(spark, shape, links)
    at = {}
    for r in e.collect():
        at.setdefault((r["a"], r["ea"]), []).append((r["b"], r["eb"]))
    return [(x, float(c)) for x, c in shape.values()], at, s, e


@pytest.mark.parametrize(("seed", "single"), [(1, False), (2, True)])
def test_pop_and_shave_equals_a_plain_version(spark, seed, single):
    shape, at, s, e = random_graph(spark, seed)
    abundance, min_length, k, extra, n = 4, 50, 6, 1, len(shape)
    length, cover = [x for x, _ in shape], [max(c - extra, 1.0) for _, c in shape]

    def sibling(i):
        found = []
        for end in (0, 1):
            if len(at.get((i, end), [])) != 1:
                return None
            beyond = sorted(b for b, _ in at[at[i, end][0]])
            if len(beyond) != 2:
                return None
            found.append(beyond[1] if beyond[0] == i else beyond[0])
        return found[0] if found[0] == found[1] != i else None

    def look(i, end, left, big):
        best = 0
        for b, eb in at.get((i, end), []):
            if cover[b] > big:
                best = max(best, 1)
            elif left - length[b] <= 0:
                return 2
            else:
                best = max(best, look(b, 1 - eb, left - length[b], big))
        return best

    kept = set()
    for i in range(n):
        twin = sibling(i)
        weak = twin is not None and (2 if single else 5) * cover[i] < cover[twin]
        if (weak and cover[i] < abundance and length[i] < min_length) or not (cover[i] > abundance or length[i] > min_length):
            continue
        lo, hi = sorted(look(i, end, 7 * k, cover[i] * (3 if cover[i] < 5 else 20)) for end in (0, 1))
        if hi == 2 or (hi == 0 and length[i] > min_length):
            kept.add(i)
    if single:
        for i in list(kept):
            near = [b for end in (0, 1) for b, _ in at.get((i, end), [])]
            if (((i, 0) in at) != ((i, 1) in at)) and 2 * cover[i] < max(cover[b] for b in near) and length[i] < 2 * min_length:
                kept.discard(i)
    while True:
        more = set()
        for i in kept:
            for end in (0, 1):
                near = at.get((i, end), [])
                if near and not any(b in kept for b, _ in near):
                    more.add(min(near, key=lambda x: (-cover[x[0]], x))[0])
        if not more:
            break
        kept |= more
    got = {r["seg"] for r in paths.pop_and_shave(s, e, abundance, min_length, k, extra, True, single).collect()}
    assert got == kept and 0 < len(kept) < n


def test_rescued_neighbours_are_written_once_and_first_looks_not_at_all(spark, monkeypatch):
    shape = {"a": (500, 30)} | {f"x{i}": (10, 1) for i in range(1, 7)}
    ids, s, e = graph_of(spark, shape, ["a+ x1+"] + [f"x{i}+ x{i + 1}+" for i in range(1, 6)])
    rows, real = [], paths.written

    def counting(frame, tag):
        out = real(frame, tag)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(paths, "written", counting)
    assert {r["seg"] for r in paths.pop_and_shave(s, e, 5, 43, 21).collect()} == set(ids.values())
    assert sum(n for tag, n in rows if tag == "kept") == len(shape)
    assert next(n for tag, n in rows if tag == "explore") == 10


def test_trimmed_overlaps_equal_a_plain_version(spark):
    shape, at, s, e = random_graph(spark, 3, 30, 40)
    overlap = {(a, ea, b, eb): (a + b) % 23 for (a, ea), near in at.items() for b, eb in near}
    lost = {(i, end): 0 for i in range(len(shape)) for end in (0, 1)}
    while True:
        able = {}
        for (i, end), near in at.items():
            far = max((overlap[i, 1 - end, b, eb] for b, eb in at.get((i, 1 - end), [])), default=0)
            t = min(min(overlap[i, end, b, eb] for b, eb in near), shape[i][0] - lost[i, 0] - lost[i, 1] - far)
            if t > 0:
                able[i, end] = t
        acting = {x: t for x, t in able.items() if all(x < y for y in at[x] if y in able) and not (x[1] == 1 and (x[0], 0) in able)}
        if not acting:
            break
        for x, t in acting.items():
            lost[x] += t
        for a, ea, b, eb in overlap:
            overlap[a, ea, b, eb] -= acting.get((a, ea), 0) + (acting.get((b, eb), 0) if (a, ea) != (b, eb) else 0)
    got, left = edit.trimmed_overlaps(s, e.withColumn("overlap", (F.col("a") + F.col("b")) % 23))
    assert {(r["seg"], r["left"], r["right"]) for r in got.collect()} == {(i, lost[i, 0], lost[i, 1]) for i in range(len(shape))}
    assert {(r["a"], r["ea"], r["b"], r["eb"]): r["overlap"] for r in left.collect()} == overlap


def test_link_edits(spark):
    ids, s, e = graph_of(spark, {"a": (10, 1), "b": (10, 1), "c": (10, 1)}, ["a+ b+"])
    more = edit.links_added(e, spark.createDataFrame([(1, 1, 2, 0)], "a long, ea int, b long, eb int"))
    assert more.count() == 4 and edit.unpaired(more).count() == 0 and edit.unpaired(more.where("a < b")).count() == 2
    assert edit.isolated(more, s.where("seg = 1")).count() == 0
    row = spark.createDataFrame([([1, 2, 3],)], "p array<int>").select(edit.broken(F.col("p"), F.lit(1)).alias("b"), edit.unrolled(F.col("p"), F.lit(2)).alias("u")).first()
    assert row["b"] == [[1], [2, 3]] and row["u"] == [1, 2, 3, 1, 2, 3]
    assert edit.shared_depth(s, spark.createDataFrame([(0, 4)], "seg long, n int")).where("seg = 0").first()["coverage"] == 0.25


def test_rings_without_length_end(spark):
    ids, s, e = graph_of(spark, {"a": (0, 5), "b": (0, 5), "c": (500, 30)}, ["a+ b+", "b+ a+"])
    assert {r["state"] for r in paths.explored(s, e, 40).where("seg = 0").collect()} == {2}
    starts = s.where("seg = 0").select("seg", F.lit(1).alias("end"), F.lit(6).alias("budget"))
    assert [r["length"] for r in paths.bounded(starts, e, s).collect()] == [6]


def walk_rows(walks_of):
    return [(r, i, x, fwd) for r, w in enumerate(walks_of) for i, (x, fwd) in enumerate(w)]


def test_untangling_copies_what_lies_between(spark):
    # two genomes share x: a x b and c x d; y is on no walk, so nothing disputes it
    ids, s, e = graph_of(spark, {"a": (100, 6), "b": (100, 6), "c": (100, 4), "d": (100, 4), "x": (100, 10), "y": (100, 1)}, ["a+ x+", "x+ b+", "c+ x+", "x+ d-", "x+ y+"])
    a, b, c, d, x, y = (ids[n] for n in "abcdxy")
    there = [[(a, True), (x, True), (b, True)]] * 6 + [[(d, True), (x, False), (c, False)]] * 4
    steps = spark.createDataFrame(walk_rows(there), "read_id long, idx int, seg long, fwd boolean")
    made, links = untangle.untangled(s, e.withColumn("overlap", F.lit(7)), steps, 3)
    got = {r["seg"]: (r["origin"], r["coverage"]) for r in made.collect()}
    assert sorted(got.values()) == [(a, 6.0), (b, 6.0), (c, 4.0), (d, 4.0), (x, 4.0), (x, 6.0), (y, 1.0)]
    named = {(got[r["a"]], r["ea"], got[r["b"]], r["eb"], r["overlap"]) for r in links.collect()}
    one = {((a, 6.0), 1, (x, 6.0), 0, 7), ((x, 6.0), 1, (b, 6.0), 0, 7), ((c, 4.0), 1, (x, 4.0), 0, 7), ((x, 4.0), 1, (d, 4.0), 1, 7)}
    assert named == one | {(q, eq, p, ep, o) for p, ep, q, eq, o in one}


def test_bridges_take_coverage_one_after_another(spark):
    # three genomes share x, which has less than they want together; y they share has more
    shape = {n: (100, c) for n, c in (("a", 6), ("b", 6), ("c", 5), ("d", 9), ("e", 4), ("f", 4), ("x", 9), ("y", 40))}
    ids, s, e = graph_of(spark, shape, [f"{p}+ x+" for p in "ace"] + ["x+ y+"] + [f"y+ {q}+" for q in "bdf"])
    a, b, c, d, g, h, x, y = (ids[n] for n in "abcdefxy")
    lines = [[(p, True), (x, True), (y, True), (q, True)] for p, q, n in ((a, b, 6), (c, d, 5), (g, h, 4)) for _ in range(n)]
    steps = spark.createDataFrame(walk_rows(lines), "read_id long, idx int, seg long, fwd boolean")

    def plain(has, wants):
        out = []
        for want in wants:
            out.append(min(want, has))
            has = max(has - out[-1], 1.0)
        return out

    for proportional in (False, True):
        made, _ = untangle.untangled(s, e, steps, 50, proportional)
        got = {}
        for r in made.orderBy("origin", "copy").collect():
            got.setdefault(r["origin"], []).append(r["coverage"])
        assert got[x] == (pytest.approx([9 * w / 15 for w in (6, 5, 4)]) if proportional else plain(9.0, [6.0, 5.0, 4.0]))
        assert got[y] == [6.0, 5.0, 4.0]


def test_duplication_to_the_fixpoint(spark):
    # s is copied for x and y; then t, whose other side the copies share, for them
    shape = {"x": (100, 10), "y": (100, 10), "s": (100, 20), "t": (100, 20), "u": (100, 10), "v": (100, 10)}
    ids, s, e = graph_of(spark, shape, ["x+ s+", "y+ s+", "s+ t+", "t+ u+", "t+ v+"])
    segments, edges = edit.duplicated(s, e.withColumn("overlap", F.lit(3)), edit.shared_ends)
    assert sorted(r["coverage"] for r in segments.collect()) == [10.0] * 8
    assert edit.unpaired(edges).count() == 0 and {r["overlap"] for r in edges.collect()} == {3}
    assert edges.join(segments.select(F.col("seg").alias("a")), "a", "left_anti").count() == 0
    whole, links = edit.duplicated(s.withColumn("parts", F.lit(1)), e, edit.exclusive_ends, merging=True)
    assert whole.agg(F.sum("coverage")).first()[0] > 0 and edit.unpaired(links).count() == 0


def plain_beyond(walks_of):
    """Paths beyond each (segment, side), as tuples of (segment, forward), with the walks' number."""
    found = {}
    for w in walks_of:
        for line, at_side in ((w, lambda f: int(f)), ([(s, not f) for s, f in reversed(w)], lambda f: int(f))):
            for i in range(len(line) - 1):
                paths_of = found.setdefault((line[i][0], at_side(line[i][1])), {})
                paths_of[tuple(line[i + 1 :])] = paths_of.get(tuple(line[i + 1 :]), 0) + 1
    return found


@pytest.mark.parametrize("seed", range(3))
def test_tries_of_long_walks_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    shared = [(rng.randrange(12), rng.random() < 0.5) for _ in range(60)]
    lines = []
    for _ in range(9):
        a = rng.randrange(20)
        line = shared[a : a + rng.choice([3, 7, 9, 14, 33, 40])]
        if rng.random() < 0.6:
            line = line + [(rng.randrange(5), True) for _ in range(rng.randrange(12))]
        lines.append(line if rng.random() < 0.7 else [(s, not f) for s, f in reversed(line)])
    lines += [lines[0], lines[3], [(1, True)], [(1, True), (2, False)]] + [[(i, True) for i in range(100, 160)]]
    steps = spark.createDataFrame(walk_rows(lines), "read_id long, idx int, seg long, fwd boolean")
    told = lambda p: "".join((">" if f else "<") + str(s) for s, f in p)
    support, strongest, tops, agreed = {}, {}, set(), {}
    for (seg, side), held in plain_beyond(lines).items():
        count, total = {}, {}
        for path, n in held.items():
            for d in range(1, len(path) + 1):
                count[path[:d]] = count.get(path[:d], 0) + n
                total[path[: d - 1]] = total.get(path[: d - 1], 0) + n
        against = {p: total[p[:-1]] - n for p, n in count.items()}
        support |= {(seg, side, told(p), len(p)): (n, against[p]) for p, n in count.items()}
        tops |= {(seg, side, told(p)) for p in held if not any(len(q) > len(p) and q[: len(p)] == p for q in held)}
        whole = lambda p, ok: next((d for d in range(len(p)) if not ok(p[: d + 1])), len(p))
        good = [p[: whole(p, lambda q: count[q] >= 2 and (against[q] == 0 or count[q] > 4))] for p in held]  # noqa: B023
        best = max(map(len, good))
        if best:
            strongest[seg, side] = min(told(p) for p in good if len(p) == best)
        fine = [p for p in held if (seg, side, told(p)) in tops and whole(p, lambda q: 0.2 * (count[q] - 1) > against[q] - 1 and against[q] < 5) == len(p)]  # noqa: B023
        win = min((p for p in fine if len(p) == max(map(len, fine))), key=told, default=None)
        agreed[seg, side] = None if win is None else told(win[: max((d + 1 for d in range(len(win)) if count[win[: d + 1]] > 1), default=0)])
    assert {(r["seg"], r["side"], r["prefix"], r["depth"]): (r["support"], r["against"]) for r in walks.prefix_support(steps).collect()} == support
    assert {(r["seg"], r["side"], r["path"]) for r in walks.maximal(steps).collect()} == tops
    assert {(r["seg"], r["side"]): r["path"] for r in walks.strong(steps).collect()} == strongest
    segments = steps.select("seg").distinct()
    got = {r["seg"]: r for r in walks.consensus(steps, segments).collect()}
    for seg, r in got.items():
        sides = [agreed.get((seg, side), "") for side in (0, 1)]
        assert (r["left_path"], r["right_path"], r["haploid"]) == (sides[0] or "", sides[1] or "", None not in sides)


def test_tries_grow_with_the_length_of_a_walk(spark):
    sizes = []
    for n in (500, 1000, 2000):
        lines = [[(i, True) for i in range(n)], [(i, i % 2 == 0) for i in range(0, 2 * n, 2)]]
        trie = walks.Beyond(spark.createDataFrame(walk_rows(lines), "read_id long, idx int, seg long, fwd boolean"))
        sizes.append(sum(known.count() for *_, known in trie.levels))
    assert sizes[1] < 2.1 * sizes[0] and sizes[2] < 2.1 * sizes[1]


def rc(text):
    return text.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_gaps_in_hits_are_filled_by_walks(spark):
    from helixframe.operators import align

    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(160))
    other = "".join(rng.choice("ACGT") for _ in range(9))
    # a, then x or y (9 bases of their own), then b: all overlap by 20
    a, x, y, b = genome[:80], genome[60:109], genome[60:80] + other + genome[89:109], genome[89:]
    segments = spark.createDataFrame(list(enumerate((a, x, rc(y), b))), "seg long, seq string")
    pairs = [(0, 1, 1, 0), (1, 1, 3, 0), (0, 1, 2, 1), (2, 0, 3, 0)]
    edges = spark.createDataFrame([(*p, 20) for p in pairs + [(q, eq, p, ep) for p, ep, q, eq in pairs]], "a long, ea int, b long, eb int, overlap int")
    wrong = {"A": "C", "C": "G", "G": "T", "T": "A"}
    middle = "".join(wrong[c] if i in (80, 88) else c for i, c in enumerate(genome))  # no k-mer of x is left
    reads = [genome[5:150], middle[5:150], rc(genome[:80] + other + genome[89:])[10:140]]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    walked = align.placed(df, segments, edges, 21, 1)
    steps = {}
    for r in walked.orderBy("read_id", "piece", "idx").collect():
        steps.setdefault((r["read_id"], r["piece"]), []).append((r["seg"], r["fwd"]))
    assert steps[0, 0] == [(0, True), (1, True), (3, True)] and steps[2, 0] == [(3, False), (2, True), (0, False)]
    # both fillers fit the gap of read 1, so it is cut there
    assert len(steps) == 4 and steps[1, 0] == [(0, True)] and steps[1, 1] == [(3, True)]
    spelled = {(r["read_id"], r["piece"]): r["seq"] for r in align.corrected(walked, segments, edges).collect()}
    # the last few places of a read aren't probed once one of them has hit
    for i in (0, 2):
        assert spelled[i, 0] == reads[i][: len(spelled[i, 0])] and len(reads[i]) - len(spelled[i, 0]) <= 4
    assert spelled[1, 0] in genome and spelled[1, 1] in genome


def plain_placed(reads, segments, edges, k, stride):
    """Reads on a graph, probe by probe: pieces of (segment, forward), with where the first starts and the last ends."""
    index = {}
    for seg, text in sorted(segments.items()):
        for c in range(0, len(text) - k + 1, stride):
            index.setdefault(text[c : c + k], (seg, c))
    size = {seg: len(text) for seg, text in segments.items()}
    near = {}
    for a, ea, b, eb, lap in edges:
        near.setdefault((a, ea), []).append((b, eb, lap))

    def listed(seg, end, budget):
        out, todo = [], [(seg, end, budget, [])]
        while todo:
            at, leave, left, path = todo.pop()
            if left <= 0 or (at, leave) not in near:
                out.append(path)
                continue
            for b, eb, lap in near[at, leave]:
                todo.append((b, 1 - eb, left - max(size[b] - lap, 1), [*path, (b, eb == 0)]))
            if len(out) + len(todo) >= 50:
                return []
        return out

    found = {}
    for name, read in reads.items():
        pieces, look, before = [], 0, None
        while look <= len(read) - k:
            word = read[look : look + k]
            fwd = word in index
            if not fwd and rc(word) not in index:
                look += 1
                continue
            seg, c = index[word] if fwd else index[rc(word)]
            start = c if fwd else size[seg] - c - k
            if pieces and pieces[-1][0][-1] == (seg, fwd):
                pieces[-1][2] = start + k
            else:
                if not pieces:
                    pieces.append([[(seg, fwd)], start, start + k])
                else:
                    walks = listed(seg, 0 if fwd else 1, look - before - start)
                    last = pieces[-1][0][-1]
                    ends = [w for w in walks if (w[-1][0] if w else seg) == last[0]]
                    if len(ends) == 1 and (ends[0][-1][1] if ends[0] else not fwd) != last[1]:
                        pieces[-1][0] += [(s, not f) for s, f in reversed(ends[0][:-1])] + [(seg, fwd)]
                        pieces[-1][2] = start + k
                    else:
                        pieces.append([[(seg, fwd)], start, start + k])
            before = look
            left = size[seg] - k - start
            step = 1 + (min(int(left * 0.8), len(read) - look - k - 5) if left > 10 else 0)
            if step <= 0:
                break
            look += step
        for p, (path, start, end) in enumerate(pieces):
            found[name, p] = (path, start, end)
    return found


def placed_pieces(walked):
    found = {}
    for r in walked.orderBy("read_id", "piece", "idx").collect():
        path, ends = found.setdefault((r["read_id"], r["piece"]), ([], []))
        path.append((r["seg"], r["fwd"]))
        ends.append((r["start"], r["end"]))
    return {key: (path, ends[0][0], ends[-1][1]) for key, (path, ends) in found.items()}


@pytest.mark.parametrize(("seed", "k"), [(0, 11), (1, 11), (2, 41)])
def test_placed_reads_equal_a_plain_version(spark, seed, k):
    from helixframe.operators import align

    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    # parts in a line, some with two or three versions, some links with an overlap of their own
    laps = [rng.choice([k - 1, k - 1, 5, 9]) for _ in range(10)]
    segments, edges, column, parts = {}, [], [], []
    joints = [text(lap) for lap in laps]
    for i in range(9):
        versions = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            body = joints[i] + text(rng.choice([4, 30, 90, 140])) + joints[i + 1]
            turned = rng.random() < 0.4
            segments[len(segments)] = rc(body) if turned else body
            versions.append((len(segments) - 1, not turned, body))
        column.append(versions)
    for i in range(8):
        for a, af, _ in column[i]:
            for b, bf, _ in column[i + 1]:
                edges.append((a, int(af), b, int(not bf), laps[i + 1]))
    edges += [(b, eb, a, ea, lap) for a, ea, b, eb, lap in edges]
    for _ in range(12):
        line, at = "", []
        for i, versions in enumerate(column):
            body = rng.choice(versions)[2]
            line += body if not i else body[laps[i] :]
        a = rng.randrange(0, 120)
        read = list(line[a : a + rng.randrange(200, 900)])
        for _ in range(rng.choice([0, 1, 4, 12])):
            j = rng.randrange(len(read))
            read[j] = rng.choice("ACGT")
        if rng.random() < 0.3:
            j = rng.randrange(len(read))
            read[j:j] = text(40)
        at = "".join(read)
        parts.append(at if rng.random() < 0.6 else rc(at))
    parts += ["", "ACGT", text(300)]
    reads = dict(enumerate(parts))
    got = align.placed(spark.createDataFrame(list(reads.items()), "read_id long, seq string"), spark.createDataFrame(list(segments.items()), "seg long, seq string"), spark.createDataFrame(edges, "a long, ea int, b long, eb int, overlap int"), k)
    want = plain_placed(reads, segments, edges, k, 5)
    assert placed_pieces(got) == want
    assert any(len(path) > 1 for path, _, _ in want.values()) and any(p for _, p in want)


def test_gaps_are_searched_one_by_one(spark):
    from helixframe.operators import align

    rng = random.Random(80)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    k, lap = 21, 20
    a, m, b = text(90), text(60), text(90)
    # a - m - b, and behind b's left end also a thicket whose walks are more than fifty for a longer gap
    segments = {0: a, 1: a[-lap:] + m + b[:lap], 2: b}
    edges = [(0, 1, 1, 0, lap), (1, 1, 2, 0, lap)]
    level = [(1, 0)]
    for _ in range(3):
        fresh = []
        for _ in range(4):
            segments[len(segments)] = text(70)
            fresh.append((len(segments) - 1, 0))
        edges += [(s, e, f, 1, lap) for s, e in level for f, _ in fresh]
        level = fresh
    edges += [(q, eq, p, ep, lap) for p, ep, q, eq, lap in edges]
    short = a + text(len(m)) + b  # the inner segment can't be hit, one walk fits
    long = text(30) + a + text(400) + b  # at the same end, but far away
    reads = {0: short, 1: long, 2: a + text(700) + b}
    want = plain_placed(reads, segments, edges, k, 1)
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "read_id long, seq string")
    contigs = spark.createDataFrame(list(segments.items()), "seg long, seq string")
    links = spark.createDataFrame(edges, "a long, ea int, b long, eb int, overlap int")
    assert want[0, 0][0] == [(0, True), (1, True), (2, True)] and (1, 1) in want and (2, 1) in want
    assert placed_pieces(align.placed(frame(reads), contigs, links, k, 1)) == want
    assert placed_pieces(align.placed(frame({0: short}), contigs, links, k, 1)) == {(0, 0): want[0, 0]}


def test_assembly_of_reads_with_errors(spark):
    from helixframe.plans import assembly

    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = []
    for i in range(60):
        at = (0, 280, 0, 280, 140)[i] if i < 5 else rng.randrange(280)
        read = list(genome[at : at + 120])
        if i % 6 == 5:
            j = rng.randrange(120)
            read[j] = rng.choice([c for c in "ACGT" if c != read[j]])
        read = "".join(read)
        rows.append((i, read if rng.random() < 0.5 else rc(read)))
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    p = assembly.Parameters(min_abundance=2, ks=(21,), compression=1, longest_read=300)
    good = assembly.correct_reads(reads, p)
    held = [r["seq"] for r in good.collect()]
    assert len(held) == 60 and all(x in genome or rc(x) in genome for x in held)
    g = assembly.resolved(assembly.cleaned(assembly.iterative(good, p.ks, 2), 21, p, 2), good, 21, p)
    found = [r["seq"] for r in g[0].collect()]
    assert len(found) == 1 and (found[0] == genome or rc(found[0]) == genome)


def test_whole_assembly_of_a_genome_with_a_repeat_and_a_variant(spark):
    from helixframe.plans import assembly

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    twice = text(260)
    genome = text(1100) + twice + text(900) + twice + text(1100)
    other = genome[:500] + text(40) + genome[540:]  # a variant that every twelfth read has
    rows = []
    for i in range(110):
        a = rng.randrange(len(genome) - 1200) if i > 9 else (0, len(genome) - 1200)[i % 2]
        read = (other if i % 12 == 11 else genome)[a : a + 1200]
        rows.append((i, read if rng.random() < 0.5 else rc(read)))
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    p = assembly.Parameters(order=15, compression=4, min_abundance=3, ks=(17, 31), longest_read=2000, k_correct=17)
    segments, links = assembly.assembly(reads, p)
    found = [r["seq"] for r in segments.collect()]
    assert found in ([genome], [rc(genome)]) and links.count() == 0
