"""Operators on clashing columns, repeated rows and very long texts; models against plain versions of what they compute."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from helixframe.llm import contamination, language, licenses, mixture, neardup, neighbours, quality, substrings, tokens, toxicity
from helixframe.llm.common import crc_fold
from helixframe.llm.queries import tokenizer_path
from tests.llm.plain import plain_posteriors, prose

CLASH = ["__p", "__text", "__row", "__id", "__kept", "__copies", "__copy", "row", "id", "kept", "copies", "copy", "evidence", "size", "target", "chance", "held_out", "score", "label", "predicted", "lang_pred", "n_words", "taken", "source_size", "spans", "rep", "rank", "block"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(30)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(120)]
    out = [(i, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (500, texts[3], "en", "s1"), (501, None, None, None), (502, "", "en", "s2"), (None, texts[5], "en", "s1"), (None, texts[6], "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark, rows):
    return spark.createDataFrame([(1, " ".join(rows[9][1].split()[:30])), (2, "not there at all")], "item_id long, text string")


def test_clashing_columns_and_repeated_rows(spark, docs, rows, labels, bench, tmp_path):
    found = {
        "toxicity": toxicity.toxicity(docs, labels),
        "mixture": mixture.mixture(docs),
        "contamination": contamination.contamination(docs, bench),
        "near": neardup.near_duplicates(docs),
        "licenses": licenses.licenses(docs),
        "language": language.language(docs),
        "tokens": tokens.token_file(docs, tokenizer_path()),
        "quality": quality.quality(docs, labels),
        "substrings": substrings.substring_dedup(docs),
    }
    for name, df in found.items():
        got = [r.asDict() for r in df.collect()]
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows), name
        if name not in ("mixture", "tokens"):  # places and draws differ
            assert len({str(sorted(r.items())) for r in got if r["doc_id"] == 3}) == 1, name
    for slice_words in (20, 1 << 20):
        stages = [quality.good(docs, labels), neardup.deduplicated(docs), contamination.clean(docs, bench, slice_words=slice_words), mixture.mixed(docs)]
        for out in stages:
            assert out.columns == docs.columns
            assert {r["copies"] for r in out.collect()} == {"clash"}


def test_neighbours_with_clashing_columns_and_repeated_ids(spark):
    rng = np.random.default_rng(31)
    rows = [(i // 2, [float(x) for x in rng.normal(size=6)], "clash") for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string").withColumn("block", F.lit(1)).withColumn("rank", F.lit(1))
    got = neighbours.neighbours(df).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80} and all(r["vec_id"] != r["query_id"] for r in got)
    assert Counter(r["query_id"] for r in got) == {q: 20 for q in (0, 20, 40, 60, 80)}


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(32)
    vocabulary = [prose(rng, 1) + str(i) for i in range(20_000)]
    passage = [f"passage{i}" for i in range(60)]
    filler = [rng.choice(vocabulary) for _ in range(250_000)]
    long = " ".join(passage + filler + passage + "released under the mit license".split())
    rows = [(1, long, "en", "s"), (2, " ".join(passage), "en", "s"), (3, long + " end", "en", "t"), (4, "x" * 400_000, "de", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (2, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    n = 250_000 + 120 + 5
    by_id = lambda d: {r["doc_id"]: r for r in d.collect()}
    gone = by_id(substrings.substring_dedup(df))
    assert gone[1]["n_removed"] == n and gone[2]["n_removed"] == 60 and gone[3]["n_removed"] == n and gone[4]["n_removed"] == 0
    hit = by_id(contamination.contamination(df, spark.createDataFrame([(7, " ".join(passage[-20:]))], "item_id long, text string")))
    assert [hit[i]["n_hit"] for i in (1, 2, 3, 4)] == [40, 20, 40, 0]
    assert by_id(neardup.near_duplicates(df))[3]["component_id"] == 1
    spot = by_id(licenses.licenses(df))
    assert spot[1]["first_word"] == n - 2 and spot[4]["n_words"] == 1
    assert by_id(mixture.mixture(df))[3]["size"] == n + 1
    plain = Tokenizer.from_file(tokenizer_path())
    held = by_id(tokens.token_file(df, tokenizer_path()))
    assert all(held[r[0]]["n_tokens"] == len(plain.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows)
    assert len(by_id(toxicity.toxicity(df, lab))) == len(by_id(language.language(df))) == len(by_id(quality.quality(df, lab))) == 4


def test_toxicity_scores_equal_a_plain_sum(spark, docs, rows, labels):
    model = toxicity.fit(docs, labels)

    def plain(text):
        code = [ord(c) if ord(c) >= 128 or c.isalnum() else 32 for c in f" {(text or '').lower()} "]
        counts = Counter()
        for order in toxicity.ORDERS:
            for i in range(len(code) - order + 1):
                h = 0
                for j, c in enumerate(code[i : i + order]):
                    h = c if j == 0 else (h * 0x01000193 + c) % 2**32
                slot = ((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS)
                if model.place[slot] >= 0:
                    counts[int(model.place[slot])] += 1
        z = model.bias + sum(model.weight[f] * math.log1p(n) for f, n in counts.items()) + model.weight[-1] * math.log(len(code) + 20) / 4
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).where("doc_id < 20").collect()}
    assert all(abs(got[i] - plain(rows[i][1])) < 1e-9 for i in range(20)) and len(set(got.values())) > 5


def test_languages_equal_plain_frame_sizes(spark, docs, rows):
    samples = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, samples).where("doc_id < 40").collect()}
    for i in range(40):
        text, sizes = rows[i][1].lower().encode(), []
        for sample in samples.values():
            zip_of = lambda level, s=sample: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(s, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            words = b" ".join(sorted(set(text.split())))
            blocks = lambda t: [t[k : k + language.BLOCK] for k in range(0, len(t), language.BLOCK)]
            sizes.append((sum(len(zip_of(language.LEVEL).compress(x)) for x in blocks(text)), sum(len(zip_of(language.SLOW).compress(language.FILL + x)) for x in blocks(words))))
        one, two = sorted(x for x, _ in sizes)
        narrow = two - one < max(language.LEAST, language.MARGIN * one)
        whole = [a + b if narrow else a for a, b in sizes]
        assert got[i]["narrow"] == narrow and got[i]["lang_pred"] == list(samples)[whole.index(min(whole))]


def test_posteriors_equal_a_plain_hierarchy(spark, docs, rows, labels):
    model = quality.fit(docs, labels)
    chance = [float(model.chances([(r[1] or "").encode()])[0]) for r in rows]

    want = defaultdict(set)
    for r, score in zip(rows, plain_posteriors([(r[3], r[2]) for r in rows], chance), strict=True):
        want[r[0]].add(round(score, 6))
    got = defaultdict(set)
    for r in quality.quality(docs, labels).collect():
        got[r["doc_id"]].add(round(r["score"], 6))
    assert got == want


def test_spans_of_many_equal_rows_are_gathered_once(spark):
    rng = random.Random(33)
    text = prose(rng, 160)
    sizes = {}
    for copies in (2, 2000):
        df = spark.createDataFrame([(None, text)] * copies + [(1, prose(rng, 50))], "doc_id long, text string").repartition(3)
        keyed = df.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("hash"))
        found = substrings.repeated(keyed).collect()
        assert len(found) == 1
        sizes[copies] = len(found[0]["spans"])
        got = Counter((r["n_removed"], r["n_words"]) for r in substrings.substring_dedup(df).collect())
        assert got == {(160, 160): copies, (0, 50): 1}
    assert sizes[2000] == sizes[2] < 60


def test_toxicity_fit_equals_a_plain_one(spark, docs, rows, labels):
    features = 300
    model = toxicity.fit(docs, labels, features=features)

    def slots(text):
        code = [ord(c) if ord(c) >= 128 or c.isalnum() else 32 for c in f" {(text or '').lower()} "]
        found = Counter()
        for order in toxicity.ORDERS:
            for i in range(len(code) - order + 1):
                h = 0
                for j, c in enumerate(code[i : i + order]):
                    h = c if j == 0 else (h * 0x01000193 + c) % 2**32
                found[((h ^ (h >> 15)) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS)] += 1
        return found, len(code)

    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if crc_fold(r["doc_id"]) != 2}
    text = {r[0]: r[1] for r in rows if r[0] in known}
    ids = sorted(text)
    y = np.array([known[i] for i in ids], float)
    held = [slots(text[i]) for i in ids]
    count = [Counter(), Counter()]
    for (found, _), label in zip(held, y, strict=True):
        count[int(label)].update(found.keys())
    n1, n0 = y.sum(), len(y) - y.sum()
    every = []
    for s in set(count[0]) | set(count[1]):
        if count[0][s] + count[1][s] >= toxicity.LEAST_DOCS:
            a, b = (count[1][s] + 1) / (n1 + 2), (count[0][s] + 1) / (n0 + 2)
            pooled = (count[0][s] + count[1][s] + 2) / (n0 + n1 + 4)
            every.append((-abs(a - b) / math.sqrt(pooled * (1 - pooled)), s, math.log(a / b)))
    chosen = sorted(every)[:features]
    assert set(np.flatnonzero(model.place >= 0).tolist()) == {s for _, s, _ in chosen} and len(chosen) == features
    r = np.array([x for *_, x in chosen] + [1.0])
    x = np.array([[math.log1p(found[s]) for _, s, _ in chosen] + [math.log(size + 20) / 4] for found, size in held]) * r
    w = np.append(np.full(len(r), 0.1), 0.0)
    m = v = np.zeros_like(w)
    for t in range(1, 251):
        miss = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        grad = np.append(x.T @ miss, miss.sum()) / len(y) + np.append(toxicity.L2 * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    prior = (n1 + 0.5) / (len(y) + 1)
    place = [int(model.place[s]) for _, s, _ in chosen]
    assert model.weight[place] == pytest.approx((w[:-1] * r)[:-1], rel=1e-4, abs=1e-6) and model.weight[-1] == pytest.approx(w[-2], rel=1e-4)
    assert model.bias == pytest.approx(w[-1] + math.log(prior / (1 - prior)) - math.log(n1 / n0), rel=1e-4)
