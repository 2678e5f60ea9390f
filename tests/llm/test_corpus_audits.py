"""Importance resampling, suffix-array dedup and source divergence against plain versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import divergence, importance, suffixes
from helixframe.llm.common import alnum_words
from tests.llm.plain import prose

DOCS = "doc_id long, text string, lang string, source string, score string, row string, rank int, block int, bucket string, spots string"


def corpus():
    rng = random.Random(70)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 40)
    texts = base + [base[3]] * 3 + ["", None, " \n", "one", "Ünï cødé " * 30, "x" * 700, "ab" * 300, "y" * 99, "y" * 100, "x" * 650]
    texts += [prose(rng, rng.randint(0, 9)) + " " + passage + prose(rng, 15) for _ in range(30)]
    edited = base[5].split()
    for k in range(6):
        words = list(edited)
        words[k * 3 % len(words)] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, "é"])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[7], rows[7], (None, base[8], "en", "s1"), (None, None, None, None), (900, "alone " * 12, "fr", "s1")]
    return [(*r, "clash", "clash", 1, 1, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).coalesce(1).repartition(1).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_features(text):
    w = alnum_words((text or "").encode())
    return [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_importance(rows, items, share=5, least=20):
    source = Counter(zlib.crc32(f) % 10000 for _, t in rows for f in plain_features(t))
    target = Counter(zlib.crc32(f) % 10000 for t in items for f in plain_features(t))
    s, t = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * float(s + 10000) / ((source[b] + 1) * float(t + 10000))))
    out = []
    for i, text in rows:
        found = plain_features(text)
        weight = sum(gain(zlib.crc32(f) % 10000) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(alnum_words((text or "").encode()))))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = share * len(able) // 100
    return Counter((*x[:4], None) for x in [*able[drawn:], *(x for x in out if x[4] < least)]) + Counter((*x[:4], k + 1) for k, x in enumerate(able[:drawn]))


def test_importance_equals_a_plain_version(spark, docs, empty):
    rows = [r[:2] for r in corpus()]
    items = ["Some Target words, " + rows[4][1], None, "", "x" * 50, *(r[1] for r in rows[10:14])]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    for share in (5, 60):
        got = importance.importance(docs.repartition(5), target, share=share)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_importance(rows, items, share)
        taken = importance.resampled(docs, target, share=share)
        assert taken.columns == docs.columns
        assert Counter(r["doc_id"] for r in taken.collect()) == Counter(r["doc_id"] for r in got.where("rank is not null").collect())
    assert importance.importance(empty, target).count() == 0 and importance.resampled(empty, target).count() == 0
    none = importance.importance(docs, target.limit(0))
    assert none.count() == len(rows) and Counter(tuple(r) for r in none.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_importance(rows, [])


def test_importance_of_many_equal_rows_and_of_a_long_text(spark):
    rng = random.Random(71)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(200_000))
    rows = [(1, long)] + [(None, "the same words again " * 6)] * 400 + [(2, "z" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.importance(df, df.where("doc_id = 1"), share=50)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_importance(rows, [long], 50)


def plain_suffixes(rows, length=100):
    """Rows in their order; of equal ids the one further up comes first."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), Counter()
    for k in order:
        text = (rows[k][1] or "").encode()
        gone = bytearray(len(text) + 1)
        for i in range(len(text) - length + 1):
            if text[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(text[i : i + length])
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        spans = sum(1 for a, b in zip(gone, gone[1:], strict=False) if a and not b)
        out[rows[k][0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "limit"), [(100, 10_000), (100, 5), (40, 3), (128, 10_000)])
def test_suffixes_equal_brute_force(docs, length, limit):
    rows = [r[:2] for r in corpus()]
    got = suffixes.suffix_dedup(docs, length, limit).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffixes(rows, length)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_suffixes_in_many_tasks_and_in_long_texts(spark, empty):
    rng = random.Random(72)
    passage = prose(rng, 60)
    long = prose(rng, 60_000)
    rows = [(k, prose(rng, 30) + passage + prose(rng, 30)) for k in range(60)] + [(100, long + passage + long[:5000]), (101, "q" * 300_000), (102, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for limit in (10_000, 20):
        got = suffixes.suffix_dedup(df, limit=limit).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_suffixes(rows)
    many = spark.createDataFrame([(None, passage)] * 500, "doc_id long, text string").repartition(5)
    assert Counter(r["n_removed"] for r in suffixes.suffix_dedup(many).collect()) == {0: 1, len(passage): 499}
    assert suffixes.suffix_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        suffixes.suffix_dedup(df, 20)


def test_multikey_order_is_the_order_of_bytes():
    rng = np.random.default_rng(73)
    rows = rng.integers(0, 3, (500, 21), np.uint8)
    rows[100:200] = rows[0:100]
    rows[:, :12][::3] = 1
    assert [bytes(x) for x in rows[suffixes.multikey(rows)]] == sorted(bytes(x) for x in rows)


def plain_divergence(rows, least=10, top=10):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        w = word.findall(low(text))
        groups[lang or "", source or ""].update(w)
        docs[lang or ""].update(set(w))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    out = Counter()
    share = lambda c, ts: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in ts) + 2 * len(ts)) for t in ts}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        ts = kept.get(lang, [])
        whole = sum((c for (a, _), c in groups.items() if a == lang), Counter())
        p, q = share(groups[lang, source], ts), share(whole, ts)
        pairs = []
        for other in (b for a, b in groups if a == lang and b != source):
            o = share(groups[lang, other], ts)
            pairs.append((-sum(f(p[t], o[t]) for t in ts), other))
        best = [(-f(p[t], q[t]), t) for t in ts if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(best, key=lambda x: (x[0], x[1].encode()))[:top])):
            for k, (v, item) in enumerate(found):
                out[lang, source, part, item, -v, k + 1] += 1
    return out


@pytest.mark.parametrize(("least", "top", "cells"), [(10, 10, 1 << 20), (2, 3, 40), (1000, 10, 1 << 20)])
def test_divergence_equals_a_plain_version(docs, least, top, cells):
    rows = [r[:4] for r in corpus()]
    got = divergence.divergence(docs.repartition(4), least, top, cells).select("lang", "source", "part", "item", "value", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_divergence(rows, least, top)


def test_divergence_of_nothing_and_exact_shares(empty):
    assert divergence.divergence(empty).count() == 0
    rng = random.Random(74)
    whole = [rng.randint(1, 9 * 10**15) for _ in range(500)]
    count = [rng.randint(0, w) for w in whole]
    assert divergence.shares(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * c // w for c, w in zip(count, whole, strict=True)]


def test_a_very_long_text_among_sources(spark):
    rng = random.Random(75)
    names = [prose(rng, 1) for _ in range(300)]
    rows = [(1, " ".join(rng.choice(names) for _ in range(150_000)), "en", "a"), (2, "Q" * 200_000, "en", "b")] + [(k, " ".join(rng.choice(names) for _ in range(30)), "en", rng.choice("abc")) for k in range(3, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = divergence.divergence(df)
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows)
