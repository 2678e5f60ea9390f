"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic regression on a few surface measures of a whole text gives each
document's evidence. Grouped aggregation then sums evidence by (host, path) and
by host, and two levels of Beta priors shrink sparse sites: a host's share of
good documents towards the global share, a path's towards its host's. The
strength of each prior comes from the spread between groups (method of
moments), within bounds. A document's posterior odds are its own evidence's
odds with the global prior replaced by its path's, from which the document's
own part has been taken out again.

In ``documents`` the host is ``source`` and the path ``lang``: the sections of a
site. Both are parameters.

The classifier is fitted on at most ``FIT_ROWS`` labelled documents a class
outside the held-out fold. Group sums cover all documents.

Defined results: null and empty texts have no words and all measures 0; null
hosts and paths are groups like any other; repeated rows count as often as they
stand; without labels of both classes the evidence is the (smoothed) share of
good labels. An empty table gives an empty result. Other columns may have any
name. Of a very long text a task holds its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, fresh, materialize, passed_on, small_batches, utf8
from .toxicity import labelled_sample, logistic

FIT_ROWS = 6000
THRESHOLD = 0.5
STRENGTH = (2.0, 1000.0)
BLOCK_WORDS = 32
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_SENTENCE = b".,;:?'-"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SENTENCE)
MEASURES = ("length", "mean word", "upper", "digit", "symbol", "sentence", "distinct", "same as before", "same as two before", "worst block upper", "worst block symbol", "worst block same", "lines again", "symbol words")


def measures(text: bytes | None) -> list[float]:
    """Surface measures of a whole text, most of them shares."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    count = lambda t, kind: len(t) - len(t.translate(None, kind))
    n, size = len(words), len(text) - count(text, _SPACE)
    same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.float64, n - 1)
    two = sum(a == b for a, b in zip(words, words[2:], strict=False))
    starts = range(0, n, BLOCK_WORDS)
    upper, symbol, again = 0.0, 0.0, 0.0
    for s in starts:
        block = b"".join(words[s : s + BLOCK_WORDS])
        if n - s < 12 and s:
            break
        letters = count(block, _UPPER) + count(block, _LOWER)
        upper = max(upper, count(block, _UPPER) / max(letters, 8))
        symbol = max(symbol, count(block, _SYMBOL) / len(block))
        again = max(again, float(same[s : s + BLOCK_WORDS - 1].sum()) / BLOCK_WORDS)
    lines = text.split(b"\n")
    letters = count(text, _UPPER) + count(text, _LOWER)
    return [
        np.log1p(n) / 10,
        min(size / n, 40) / 10,
        count(text, _UPPER) / max(letters, 1),
        count(text, _DIGIT) / size,
        count(text, _SYMBOL) / size,
        count(text, _SENTENCE) / size,
        len(set(words)) / n,
        float(same.sum()) / n,
        two / n,
        upper,
        symbol,
        again,
        1 - len(set(lines)) / len(lines),
        sum(not w.translate(None, _SYMBOL) for w in words) / n,
    ]


@dataclass
class Evidence:
    """A logistic regression on standardised measures and their squares."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, z**2 / 4])

    def chances(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(texts), self.prior)
        z = self.design(np.array([measures(t) for t in texts]).reshape(-1, len(MEASURES))) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Evidence:
    small_batches(docs.sparkSession)
    sample, all_labels = labelled_sample(docs, labels, "quality", fit_rows)
    prior = (all_labels[1] + 0.5) / (sum(all_labels) + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([measures(t) for t in utf8(batch["text"])], pa.list_(pa.float64()))], names=["label", "x"])

    # at most 2 * fit_rows rows, one an id
    got = sample.mapInArrow(measure, "label int, x array<double>").collect()
    discard(sample)
    y = np.array([r["label"] for r in got], float)
    if not 0 < y.sum() < len(y):
        return Evidence(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, prior)
    x = np.array([r["x"] for r in got])
    model = Evidence(x.mean(0), x.std(0) + 1e-6, np.zeros(0), 0.0, prior)
    design = model.design(x)
    rows, columns = np.divmod(np.arange(design.size), design.shape[1])
    model.weight, model.bias = logistic(rows, columns, design.ravel(), y, design.shape[1], l2=1e-3, steps=600, start=0.0)
    model.bias += float(np.log(prior / (1 - prior)) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def with_evidence(docs: DataFrame, model: Evidence, name: str = "__p") -> DataFrame:
    """``docs`` with all its columns and, as ``name``, the classifier's chance that the document is good."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    (text,) = fresh(docs, "__text")
    texts = docs.withColumn(text, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = shared.value.chances(list(utf8(batch[text])))
            yield passed_on(batch.drop_columns([text]), {name: pa.array(chances)})

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return texts.mapInArrow(run, f"{kinds}, `{name}` double")


def _strength(groups: DataFrame) -> float:
    """Prior strength from group sums: how much wider group means spread than single documents explain."""
    m = F.col("__sum") / F.col("__n")
    row = groups.where("__n > 1").agg(F.count("*").alias("k"), F.sum("__n").alias("n"), (F.sum("__sum") / F.sum("__n")).alias("mean"), F.sum(F.col("__n") * m * m).alias("square"), F.sum(F.col("__squares") - F.col("__sum") * m).alias("within")).first()
    if not row["k"] or row["k"] < 2:
        return STRENGTH[1]
    within = row["within"] / max(row["n"] - row["k"], 1)
    between = (row["square"] / row["n"] - row["mean"] ** 2) - within * (row["k"] - 1) / row["n"]
    spread = max(row["mean"] * (1 - row["mean"]), 1e-6)
    return float(np.clip(spread / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))


def sites(evidence: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row a (host, path): sums of evidence and both levels' prior, ready to be joined."""
    paths = materialize(evidence.groupBy(host.alias("__host"), path.alias("__path")).agg(F.count("*").alias("__n"), F.sum("__p").alias("__sum"), F.sum(F.col("__p") ** 2).alias("__squares")), "sites")
    hosts = paths.groupBy("__host").agg(*(F.sum(c).alias(c) for c in ("__n", "__sum", "__squares")))
    total = hosts.agg(F.sum("__sum").alias("s"), F.sum("__n").alias("n")).first()
    share = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    a, b = _strength(hosts), _strength(paths)
    shares = hosts.select(F.col("__host").alias("__h"), ((F.lit(a * share) + F.col("__sum")) / (a + F.col("__n"))).alias("__host_share"))
    return paths.join(shares, F.col("__host").eqNullSafe(F.col("__h"))).select("__host", "__path", "__n", "__sum", "__host_share", F.lit(b).alias("__strength"), F.lit(share).alias("__share"))


def posterior(evidence: DataFrame, groups: DataFrame, host: Column, path: Column) -> DataFrame:
    """Adds ``__site`` (the path's share of good documents without this one) and ``__score``, the posterior."""
    logit = lambda p: F.log(p / (1 - p))
    joined = evidence.join(groups, host.eqNullSafe(groups["__host"]) & path.eqNullSafe(groups["__path"]))
    site = (F.col("__strength") * F.col("__host_share") + F.col("__sum") - F.col("__p")) / (F.col("__strength") + F.col("__n") - 1)
    site = F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4))
    share = F.least(F.greatest(F.col("__share"), F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = joined.withColumn("__site", site)
    return joined.withColumn("__score", 1 / (1 + F.exp(-(logit(F.col("__p")) - logit(share) + logit(F.col("__site"))))))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: evidence, the site's posterior share, the document's posterior, and whether it is kept."""
    thin = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    evidence = materialize(with_evidence(thin, fit(docs, labels)).drop("text"), "evidence")
    groups = materialize(sites(evidence, F.col("host"), F.col("path")), "site-shares")
    out = posterior(evidence, groups, F.col("host"), F.col("path"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "host", "path", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("__p").alias("evidence"), F.col("__site").alias("site"), F.col("__score").alias("score"), (F.col("__score") >= threshold).alias("kept"))


def good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose posterior is below the threshold; all columns stay."""
    (name,) = fresh(docs, "evidence")
    # written once: sums and posteriors both need it, and measuring texts is what costs
    evidence = materialize(with_evidence(docs, fit(docs, labels), name), "evidence")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # of its own, the operator's names can't clash with any
    plain = evidence.toDF(*columns, "__p")
    h, p = (F.col(columns[docs.columns.index(c)]).cast("string") for c in (host, path))
    groups = materialize(sites(plain, h, p), "site-shares")
    kept = posterior(plain, groups, h, p).where(F.col("__score") >= threshold)
    return kept.select(*(F.col(c).alias(was) for c, was in zip(columns, docs.columns, strict=True)))
