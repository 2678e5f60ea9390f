"""Importance resampling towards a target: hashed n-gram features through an integer word dictionary.

A document's features are its runs of 1 to ``order`` consecutive words, repeats
counted; a feature's bucket is the crc32 of its bytes modulo ``buckets``. Counts
by bucket over all documents and over the target give each bucket a gain, a
document's weight is the sum of its features' gains, and a fixed draw by
document id (Gumbel noise from a hash) plus the weight decides who is taken.

Texts are read in stretches of some megabytes. In each, distinct words get
integers, an n-gram is the integer of the (n-1)-gram before its last word and the
integer of that word, and distinct n-grams are found by sorting those. Only a
distinct one is spelled and hashed, once, by running its last word's bytes on from
the checksum of what stands before them; counts and gains come back by the
inverse of the sort. The dictionary is one for each stretch and not for the whole corpus: a global one
would have to be joined with every word of every text, a shuffle of several
times the input, and the checksum of a tuple is the same wherever it is made.

Two passes over the texts, no text is shuffled: a task hands on one count a
bucket, the gains (``buckets`` numbers, 80 kB) go to all tasks, and the draw is
a distributed sort of (score, id). Nothing else reaches the driver. Memory of a
task is some arrays of a number a word of a stretch, or of its longest document.

Defined results: null and text without words have no features, weight 0, and a
score, but are never drawn (``least`` words are needed); a null id is the empty
text in the hash and comes after all others in ties; repeated rows are rows like
others, and of rows that are equal in score and id it is open which comes first;
other columns are ignored; an empty table gives an empty result; without target texts all t are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.loop import numbered
from .common import alnum_words, fresh, materialize, passed_on, small_batches, stretches, utf8, word_ids

BUCKETS = 10_000
ORDER = 3
SEED = 42
LEAST = 20
STRETCH = 6_000_000

Grams = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def grams(each: list[list[bytes]], order: int, buckets: int) -> Grams:
    """For each n up to ``order``: bucket of each distinct n-gram, which of them stands at each place, and the place's document."""
    ids, doc, vocabulary = word_ids(each)
    words = vocabulary.to_pylist()
    spaced = [b" " + w for w in words]
    size = max(len(words), 1)
    sums = list(map(crc32, words))
    out = [(np.array(sums, np.int64) % buckets, ids, doc)]
    at, name = np.arange(len(ids)), ids
    for n in range(2, order + 1):
        # an (n-1)-gram goes on where the next word is of the same document
        on = at + n - 1 < len(ids)
        on[on] = doc[at[on] + n - 1] == doc[at[on]]
        at, name = at[on], name[on]
        tuples, name = np.unique(name * size + ids[at + n - 1], return_inverse=True)
        sums = list(map(crc32, map(spaced.__getitem__, (tuples % size).tolist()), map(sums.__getitem__, (tuples // size).tolist())))
        out.append((np.array(sums, np.int64) % buckets, name, doc[at]))
    return out


def _counted(order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = list(utf8(batch["text"]))
            for part in stretches(texts, STRETCH):
                for bucket, name, _ in grams([alnum_words(t) for t in texts[part]], order, buckets):
                    times = np.bincount(name, minlength=len(bucket))
                    total += np.bincount(bucket, weights=times, minlength=buckets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array(total)], names=["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(order, buckets), "bucket int, n long")
    out = [0] * buckets
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """By bucket: the log of the target's smoothed share over the source's, in thousandths, rounded down."""
    n, m, whole = len(source), sum(target), sum(source)
    return [math.floor(1000 * math.log((t + 1) * float(whole + n) / ((s + 1) * float(m + n)))) for s, t in zip(source, target, strict=True)]


def _weighed(column: str, order: int, gain: list[int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.float64)
        for batch in batches:
            texts = list(utf8(batch[column]))
            n_words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for part in stretches(texts, STRETCH):
                each = [alnum_words(t) for t in texts[part]]
                n_words[part] = [len(w) for w in each]
                for bucket, name, doc in grams(each, order, len(gain)):
                    features[part] += np.bincount(doc, minlength=len(each))
                    # whole numbers far below 2**53, so exact
                    weight[part] += np.bincount(doc, weights=worth[bucket][name], minlength=len(each)).astype(np.int64)
            yield passed_on(batch, dict(zip(names, map(pa.array, (n_words, features, weight)), strict=True)))

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256(``seed:id``)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, target: DataFrame, order: int, buckets: int, seed: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with words, features, weight and score added, and the names of those."""
    gain = gains(feature_counts(docs, order, buckets), feature_counts(target, order, buckets))
    names = fresh(docs, "n_words", "n_features", "weight", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` bigint" for n in names[:3])])
    weighed = docs.mapInArrow(_weighed("text", order, gain, names[:3]), schema)
    return weighed.withColumn(names[3], F.col(names[2]) + noise(F.col("doc_id"), seed)), names


def importance(docs: DataFrame, target: DataFrame, share: int = 5, least: int = LEAST, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of all rows; rank from 1 for those drawn, else null.

    Of the rows with at least ``least`` words, ``share`` percent (rounded down) with the highest scores are drawn.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored, _ = _scored(ids, target, order, buckets, seed)
    scored = materialize(scored.drop("text").withColumn("row", F.monotonically_increasing_id()), "scored")
    able = scored.where(F.col("n_words") >= least)
    drawn = share * able.count() // 100
    # the row comes last, so that many equal scores are dealt out too
    ranked = numbered(able.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"), "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.where(F.col("n_words") < least).withColumn("place", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"), "n_words")


def resampled(docs: DataFrame, target: DataFrame, share: int = 5, least: int = LEAST, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns; rows equal in id and score to the last one drawn come too.

    Texts are read, not shuffled: the last drawn score and id is all that a row is compared with.
    """
    ranks = importance(docs, target, share, least, order, buckets, seed)
    last = ranks.where("rank is not null").agg(F.max(F.struct("rank", "score", "doc_id")).alias("x")).first()["x"]
    if last is None:
        return docs.limit(0)
    scored, (n_words, _, _, score) = _scored(docs, target, order, buckets, seed)
    doc_id = F.col("doc_id").cast("long")
    upto = F.lit(True) if last["doc_id"] is None else F.coalesce(doc_id <= last["doc_id"], F.lit(False))
    kept = (F.col(score) > last["score"]) | ((F.col(score) == last["score"]) & upto)
    return scored.where((F.col(n_words) >= least) & kept).select(*docs.columns)
