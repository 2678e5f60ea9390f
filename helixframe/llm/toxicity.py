"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are logarithmic counts of character n-grams (``ORDERS`` code points,
lower-cased, everything that is neither letter nor digit as a space) hashed
into ``2**BITS`` slots, and the logarithm of the text's length, which says how
many to expect by chance. Fitting counts, for each slot, the toxic and the clean
training documents that have it; the ratio of their smoothed shares is the
slot's log-count ratio r. The slots with the strongest association keep their
place, and a logistic regression is fitted on features scaled by r.

Training takes at most ``FIT_ROWS`` labelled documents of each class, those
with the smallest hash of their id, and of an id on several rows the text with
the smallest hash; whole texts always. Fitting gathers only
per-slot counts (dense, summed in slices) and, for the bounded sample, the kept
slots a document has. The intercept is moved from the sample's class balance to
that of all labelled training rows.

Defined results: null and empty texts score as documents without features; a
null label teaches nothing; an id labelled twice is toxic if any label says so;
null ids can't be labelled; with one class or no labels at all every score is
that share (0.5 without labels, 0 < score < 1 always). Repeated rows score
equal. Other columns are ignored. Of a very long text a task holds some arrays of
a number a character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below, discard, fold, materialize, small_batches, utf8

ORDERS = (3, 4, 5, 6)
BITS = 20
FIT_ROWS = 6000
FEATURES = 2500
LEAST_DOCS = 4
L2 = 3e-4
CHUNK = 80_000
SLICES = 32
_PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)], np.uint32)


def codes_of(text: bytes | None) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    code = np.frombuffer(f" {(text or b'').decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _PLAIN[np.minimum(code, 127)], code)


def slots_of(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the slot of the n-gram that starts at each position."""
    rolled = code.copy()
    for order in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + code[order - 1 :]
        if not len(rolled):
            return
        if order in ORDERS:
            yield order, ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def chunks_of(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Neighbouring documents' codes together: index of the first, where each starts, codes."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(codes_of(text))
        size += len(held[-1])
        if size >= CHUNK or k == len(texts) - 1:
            yield first, np.cumsum([0, *map(len, held)]), np.concatenate(held)
            first, held, size = k + 1, [], 0


def present(texts: list[bytes | None], place: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs and their counts, and code points a document; ``place`` maps slots to features, below 0 for none."""
    rows, features, times, lengths = [], [], [], []
    for first, starts, code in chunks_of(texts):
        keys = []
        for order, slots in slots_of(code):
            if place is None:
                at, feature = np.arange(len(slots)), slots.astype(np.int64)
            else:
                feature = place[slots]
                at = np.flatnonzero(feature >= 0)
                feature = feature[at].astype(np.int64)
            doc = np.searchsorted(starts, at, "right") - 1
            inside = at + order <= starts[doc + 1]
            keys.append(doc[inside] * width + feature[inside])
        found, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        rows.append(found // width + first)
        features.append(found % width)
        times.append(n)
        lengths.append(np.diff(starts))
    return tuple(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows, features, times, lengths))


def with_length(rows: np.ndarray, features: np.ndarray, values: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more feature a document, numbered ``width``: the logarithm of its length."""
    return np.append(rows, np.arange(len(lengths))), np.append(features, np.full(len(lengths), width)), np.append(values, np.log(lengths + 20.0) / 4)


@dataclass
class Model:
    place: np.ndarray  # slot -> feature or -1
    weight: np.ndarray  # by feature, the length's last
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.weight) and texts:
            width = len(self.weight) - 1
            rows, features, times, lengths = present(texts, self.place, width)
            rows, features, values = with_length(rows, features, np.log1p(times), lengths, width)
            z += np.bincount(rows, self.weight[features] * values, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        label = np.array(batch["label"].to_pylist(), np.int64)
        rows, slots, _, _ = present(list(utf8(batch["text"])), None, 1 << BITS)
        for y in (0, 1):
            counts[y] += np.bincount(slots[label[rows] == y], minlength=1 << BITS).astype(np.int32)
    parts = counts.reshape(2, SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([parts[:, k].tobytes() for k in range(SLICES)], pa.binary())], names=["slice", "counts"])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    both = sum(np.frombuffer(x, np.int32).reshape(2, -1).astype(np.int64) for x in pdf["counts"])
    at = np.flatnonzero(both.sum(0) >= LEAST_DOCS)
    return pd.DataFrame({"slot": at + int(pdf["slice"].iloc[0]) * both.shape[1], "n0": both[0, at], "n1": both[1, at]})


def _vectors(place: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, features, times, lengths = present(list(utf8(batch["text"])), place, width)
            ends = np.searchsorted(rows, np.arange(len(batch) + 1))
            pairs = np.stack([features, times], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(lengths, pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["label", "length", "features"])

    return vectors


def logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-3, steps: int = 250, start: float = 0.5) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse rows by full-batch Adam steps."""
    n = max(len(y), 1)
    w = np.full(width + 1, start)
    w[-1] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[features] * values, len(y)) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(features, miss[rows] * values, width), miss.sum()) / n
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> tuple[DataFrame, list[int]]:
    """Training documents with their label, at most ``fit_rows`` a class and one row an id; and all training labels by class."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("__id").isNotNull() & F.col("label").isin(0, 1)).groupBy("__id").agg(F.max("label").alias("label")).where(fold(F.col("__id")) != 2)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where((F.col("label") == y) & below(F.xxhash64("__id"), fit_rows, counts.get(y, 0))).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * fit_rows ids: a proven bound for the broadcast
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    sample = mine.groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
    return materialize(sample, "sample"), [counts.get(0, 0), counts.get(1, 0)]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample, all_labels = labelled_sample(docs, labels, "toxic", fit_rows)
    nothing = np.full(1 << BITS, -1, np.int32)
    prior = (all_labels[1] + 0.5) / (sum(all_labels) + 1)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not all(sizes.get(y) for y in (0, 1)):
        return Model(nothing, np.zeros(0), float(np.log(prior / (1 - prior))))
    counted = sample.coalesce(8).mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInPandas(_sum, "slot long, n0 long, n1 long")
    share1, share0 = (F.col("n1") + 1) / (sizes[1] + 2), (F.col("n0") + 1) / (sizes[0] + 2)
    pooled = (F.col("n1") + F.col("n0") + 2) / (sizes[1] + sizes[0] + 4)
    strength = F.abs(share1 - share0) / F.sqrt(pooled * (1 - pooled))
    kept = counted.select("slot", F.log(share1 / share0).alias("r"), strength.alias("s")).orderBy(F.desc("s"), "slot").limit(features).toPandas()
    place = nothing.copy()
    place[kept["slot"].to_numpy()] = np.arange(len(kept), dtype=np.int32)
    r = kept["r"].to_numpy()
    got = sample.mapInArrow(_vectors(place, len(kept)), "label int, length long, features binary").toPandas()
    each = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in got["features"]]
    flat = np.concatenate([*each, np.zeros((0, 2), np.int32)])
    rows, columns, values = with_length(np.repeat(np.arange(len(each)), [len(x) for x in each]), flat[:, 0], np.log1p(flat[:, 1]), got["length"].to_numpy(), len(kept))
    r = np.append(r, 1.0)
    weight, bias = logistic(rows, columns, values * r[columns], got["label"].to_numpy(float), len(r), l2=L2, start=0.1)
    discard(sample)
    return Model(place, weight * r, bias + float(np.log(prior / (1 - prior)) - np.log(sizes[1] / sizes[0])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score`` for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(shared.value.scores(list(utf8(batch["text"]))))], names=["doc_id", "held_out", "score"])

    ids = F.col("doc_id")
    return docs.select(ids.cast("long").alias("doc_id"), (fold(ids) == 2).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on ``labels.toxic`` and score every whole text."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
