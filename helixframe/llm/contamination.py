"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Both sides are lower-cased (A-Z) and cut into words. Every window of ``n``
benchmark words (an item with fewer words is one window of its own length)
goes into a hash set; each document's word positions whose words all occur in
the benchmark are hashed the same way, looked up, and verified word by word.

The set is broadcast in slices of about ``slice_words`` benchmark words. A word
starts at most one window, and a slice is arrays of packed word numbers, hashes
and owners, some 100 bytes a word, so the bound on words is one on memory. Long
items are cut into overlapping pieces, which fall into slices by themselves. One
slice is the usual case; a larger benchmark takes a pass over the documents for
each slice, with the hits found so far carried along, so what a task holds does
not grow with the benchmark.

Defined results: a null or empty text has no words, no hits and is not
contaminated; an item without words has no windows; repeated items count once
by their id; repeated rows are judged each for itself; an empty benchmark hits
nothing. Other columns of either table are ignored. Of one very long text a task
holds its words and a few numbers a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, fresh, materialize, small_batches, utf8

N = 13
SLICE_WORDS = 1 << 20
PIECE_WORDS = 1 << 12


class WindowSet:
    """Windows of one slice of the benchmark, by length: distinct rows of word numbers, ascending by hash, and their owners.

    ``items`` has an item, the text, and how many words a window of the item has (None: ``n``, or all of a shorter text).
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text)], np.int32)
            size = min(n, len(ids))
            if not size:
                continue
            rows, owners = found.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owners.append(np.full(len(ids) - size + 1, names.setdefault(item, len(names)), np.int32))
        self.items = list(names)
        self.factors = {size: np.random.default_rng(size).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1) for size in found}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in list(found):
            rows, owners = map(np.concatenate, found.pop(size))
            hashed = self._hash(rows, size)
            order = np.lexsort((*rows.T, hashed))
            rows, owners, hashed = rows[order], owners[order], hashed[order]
            fresh = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
            self.tables[size] = hashed[fresh], rows[fresh], np.append(fresh, len(rows)), owners

    def _hash(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j, factor in enumerate(self.factors[size]):
            out += rows[:, j].astype(np.uint64) * factor
        return out

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that a window covers, and the items whose windows occur."""
        spans, items = [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, (known, windows, starts, owners) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            rows = ids[at[:, None] + np.arange(size)]
            hashed = self._hash(rows, size)
            low, high = np.searchsorted(known, hashed, "left"), np.searchsorted(known, hashed, "right")
            for k in np.flatnonzero(high > low).tolist():
                for w in range(low[k], high[k]):  # one, unless hashes collide
                    if (windows[w] == rows[k]).all():
                        spans.append((int(at[k]), int(at[k]) + size))
                        items.update(self.items[o] for o in set(owners[starts[w] : starts[w + 1]].tolist()))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "row long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<a:int,b:int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _judged(doc_ids: pa.Array, n_words: list[int], all_spans: list[list[tuple[int, int]]], all_items: list[list[str]]) -> pa.RecordBatch:
    n_hit = [sum(b - a for a, b in s) for s in all_spans]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in all_items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in all_items], pa.string()),
            pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_()),
            pa.array([[{"a": a, "b": b} for a, b in s] for s in all_spans], _SPANS),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def _scanner(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of rows against the whole benchmark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = shared.value
        for batch in batches:
            texts = [alnum_words(t) for t in utf8(batch["text"])]
            found = [known.spans(words) for words in texts]
            yield _judged(batch["doc_id"], [len(w) for w in texts], [merged(s) for s, _ in found], [sorted(i) for _, i in found])

    return scan


def _hits(shared, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hits of rows in one slice of the benchmark; rows without one only if ``every`` row is wanted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for row, text in zip(batch["row"].to_pylist(), utf8(batch["text"]), strict=True):
                words = alnum_words(text)
                spans, items = known.spans(words)
                if spans or every:
                    rows.append((row, len(words), [{"a": a, "b": b} for a, b in merged(spans)], sorted(items)))
            kinds = (pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "n_words", "spans", "items"])

    return scan


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged([(x["a"], x["b"]) for part in row for x in part]) for row in batch["spans"].to_pylist()]
        items = [sorted({x for part in row for x in part}) for row in batch["items"].to_pylist()]
        yield _judged(batch["doc_id"], batch["n_words"].to_pylist(), spans, items)


def _pieces(n: int, piece_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as words joined by spaces, long ones cut so that each window of ``n`` words is whole in one piece."""
    step = max(piece_words - n + 1, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, texts = [], [], []
            for item, text in zip(batch["item"].to_pylist(), utf8(batch["text"]), strict=True):
                words = alnum_words(text)
                for at in range(0, max(len(words) - n + 1, 1) if words else 0, step):
                    part = words[at : at + step + n - 1]
                    items.append(item)
                    sizes.append(len(part))
                    texts.append(b" ".join(part).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], names=["item", "size", "words"])

    return cut


def _slices(benchmark: DataFrame, n: int, slice_words: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = materialize(items.mapInArrow(_pieces(n, min(PIECE_WORDS, max(slice_words, n))), "item string, size long, words string").distinct(), "benchmark")
    size = pieces.agg(F.sum("size")).first()[0] or 0
    k = -(-size // slice_words) or 1
    return [pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(k)) == i) for i in range(k)] if k > 1 else [pieces]


def _shared(part: DataFrame, n: int):
    # slices hold about slice_words words each
    return part.sparkSession.sparkContext.broadcast(WindowSet([(r["item"], r["words"].encode()) for r in part.toLocalIterator()], n))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Per row of ``docs``: hit words, items found, the merged hit spans, and whether it is contaminated.

    A benchmark of one slice is met as the rows stream by. With more, rows are written down once with a
    number; each slice reads them and writes its hits alone, which are gathered by row.
    """
    small_batches(docs.sparkSession)
    slices = _slices(benchmark, n, slice_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(slices) == 1:
        return texts.mapInArrow(_scanner(_shared(slices[0], n)), RESULT)
    numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for k, part in enumerate(slices):
        shared = _shared(part, n)
        hits = materialize(numbered.select("row", "text").mapInArrow(_hits(shared, not k), HITS), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return numbered.select("row", "doc_id").join(each, "row").select("doc_id", "n_words", "spans", "items").mapInArrow(_gathered, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay.

    Each row is judged by its own text. With one slice that happens as it streams
    by; with more, rows are written down with a number by which the verdict finds them.
    """
    small_batches(docs.sparkSession)
    slices = _slices(benchmark, n, slice_words)
    if len(slices) > 1:
        (row,) = fresh(docs, "row")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        bad = contamination(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, n, slice_words).where("contaminated").select(F.col("doc_id").alias(row))
        return numbered.join(bad, row, "left_anti").select(*docs.columns)
    shared = _shared(slices[0], n)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = shared.value
        for batch in batches:
            good = []
            for text in utf8(batch["text"]):
                words = alnum_words(text)
                hit = sum(b - a for a, b in merged(known.spans(words)[0]))
                good.append(not (hit and 20 * hit >= len(words)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` (and what stands between the words of one span)."""
    if not text or not spans:
        return text
    import re

    found = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return "".join([*out, text[at:]])
