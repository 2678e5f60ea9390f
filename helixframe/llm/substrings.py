"""Substring dedup by recompression: repeated windows of words, found through globally named symbols.

A document is a sequence of words (between ASCII white space, unchanged).
Recompression shortens it in rounds: first maximal runs of a word, then, round
after round, adjacent pairs whose left symbol falls into the left half and whose
right symbol into the right half of the alphabet get one new name. A name is a
hash of what it stands for and the halves are hashes of names, so names agree
in all documents and rounds without a shuffle, and equal substrings get equal
symbols wherever the decisions depended on words inside them. For each symbol
the span of words is kept on which its existence depends.

For a window of ``window`` words, the symbols that depend on its own words alone
are the same in every place where the window occurs. Its *anchor* is the one of
them with the smallest hash, so equal windows have equal anchors at equal
offsets. A window without such a symbol (inside long runs) is its own anchor,
by its hash; that too depends on its words alone. Consecutive windows with one
anchor form an *entry*: a name and a hash of the words around the anchor that
the entry's windows cover. Entries are about one for a dozen words.

1. Entries are counted by name. A name that occurs once has no repeated window.
2. Where all entries of a name have the same surroundings, all their windows
   are repeated.
3. Where they differ (at the ends of a repeated passage), one entry of each kind
   of surroundings has its windows hashed from the text; a window repeats where
   its hash comes from two places.

The name under which an entry is counted is that of all the words on which its
anchor depends: they stand in each of its windows, and a short symbol alone
would bring together windows that share two common words.

Each step is a grouped count with partial aggregation or an equi-join, so one
passage in a third of all documents costs its rows but is never gathered. Of
rows equal in id and text one has its spans gathered, for all of them.
Texts are joined twice, by document, each time once through a shuffle.

Long runs (over ``RUN`` words) stay as single words. Symbols beside one depend on
its nearest word, as beside a short run; no symbol may depend on more of it.
Equality is that of two 64-bit hashes: of the words that decided on the anchor
(equal windows have equal ones) and of all words. All decisions are symmetric, no
window is dropped. Of a very long text a task holds some arrays of a number a word.

Defined results: null and empty texts have no words, nothing removed and the
hash of the empty text; repeated rows repeat each other's windows; null ids
are ids like others; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, discard, materialize, mixed, release, small_batches, space_words, utf8, word_hashes

WINDOW = 35
ROUNDS = 6
RUN = 8
LONGEST = 16
CHUNK = 60_000
MEMO = 120_000
_SALT = mixed(np.arange(101, 101 + ROUNDS, dtype=np.uint64))


class Words:
    """Word hashes of some documents one after another, each behind a separator; hashes of any stretch."""

    def __init__(self, texts: list[bytes | None], memo: dict[bytes, int], powers: Powers):
        if len(memo) > MEMO:
            memo.clear()
        each = [space_words(t) for t in texts]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(np.concatenate(([1], self.counts[:-1] + 1))) if len(each) else np.zeros(0, np.int64)
        n = int(self.counts.sum()) + len(each) + 1
        self.hash = np.zeros(n, np.uint64)
        self.real = np.zeros(n, bool)
        for start, words in zip(self.starts.tolist(), each, strict=True):
            if words:
                self.hash[start : start + len(words)] = word_hashes(words, memo)
                self.real[start : start + len(words)] = True
        up, self.down = powers.to(n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * up[:n])))

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words in [a, b)."""
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Where a window can start."""
        ends = np.maximum(self.counts - size + 1, 0)
        first = np.repeat(self.starts, ends)
        return first + np.arange(len(first)) - np.repeat(np.cumsum(ends) - ends, ends)


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After all rounds: name, start, and the span [first, last) of words that decided on the symbol; all ascending."""
    name, n = words.hash, len(words.hash)
    # runs of a word
    head = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | ~words.real[1:] | ~words.real[:-1])))
    length = np.diff(np.append(head, n))
    long = np.repeat(length > RUN, length)
    keep = long.copy()
    keep[head] = True
    size = np.ones(n, np.int64)
    size[head] = np.where(length <= RUN, length, 1)
    start = np.flatnonzero(keep)
    size, hard = size[start], (long | ~words.real)[start]
    name = np.where(size > 1, mixed(name[start] + size.astype(np.uint64)), name[start])
    end = start + size
    # beside a long run, one of its words tells that a symbol ends; only what waits for the run's own name is undecided
    first, last, bad = start - 1, end + 1, hard.copy()
    for salt in _SALT:
        left = (mixed(name ^ salt) & np.uint64(1)).astype(bool)
        right = ~left & ~hard
        left &= ~hard
        pair = left[:-1] & right[1:] & (end[1:] - start[:-1] <= LONGEST)
        one = np.flatnonzero(pair)
        new_last, new_bad, new_first = last.copy(), bad.copy(), first.copy()
        alone = np.flatnonzero(left[:-1] & ~pair)  # depends on what follows
        new_last[alone] = np.maximum(last[alone], last[alone + 1])
        new_bad[alone] |= bad[alone + 1]
        alone = np.flatnonzero(right[1:] & ~pair) + 1  # depends on what precedes
        new_first[alone] = np.minimum(first[alone], first[alone - 1])
        new_bad[alone] |= bad[alone - 1]
        new_last[one], new_bad[one] = np.maximum(last[one], last[one + 1]), bad[one] | bad[one + 1]
        name, end = name.copy(), end.copy()
        name[one] = mixed(name[one] * np.uint64(3) + mixed(name[one + 1]))
        end[one] = end[one + 1]
        keep = np.ones(len(name), bool)
        keep[one + 1] = False
        name, start, end, first, last, bad, hard = (x[keep] for x in (name, start, end, new_first, new_last, new_bad, hard))
    good = ~bad
    return name[good], start[good], first[good], last[good]


def entries(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Name, surroundings, first and last window start of each entry, ascending by place."""
    s = words.windows(window)
    none = np.zeros(0, np.int64)
    if not len(s):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    name, start, first, last = symbols(words)
    lo = np.searchsorted(first, s, "left")
    hi = np.searchsorted(last, s + window, "right")
    picked = np.full(len(s), -1, np.int64)
    some = np.flatnonzero(hi > lo)
    if len(some):
        # smallest hash first, then the leftmost: the hash's rank above 32 bits of place, which hold any number of symbols
        low = np.int64(0xFFFFFFFF)
        rank = np.unique(mixed(name), return_inverse=True)[1].astype(np.int64)
        table = [(rank << np.int64(32)) | np.arange(len(name), dtype=np.int64)]
        lo, hi = lo[some], hi[some]
        level = np.frexp(hi - lo)[1] - 1
        for k in range(int(level.max())):
            step = 1 << k
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        for k, row in enumerate(table):
            at = np.flatnonzero(level == k)
            best = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
            picked[some[at]] = best & low
    # consecutive windows with one anchor; windows without one stand alone
    fresh = np.concatenate(([True], (picked[1:] != picked[:-1]) | (picked[1:] < 0) | (s[1:] != s[:-1] + 1)))
    at = np.flatnonzero(fresh)
    a, b, anchor = s[at], s[np.append(at[1:], len(s)) - 1], picked[at]
    around = words.stretch(a, b + window)
    key, offset = around ^ np.uint64(0x5851F42D4C957F2D), np.zeros(len(a), np.int64)
    named = np.flatnonzero(anchor >= 0)
    if len(named):
        # all words that decided on the symbol stand in the window, and tell more than the symbol's own
        at = anchor[named]
        key[named] = mixed(words.stretch(first[at], last[at]) + (start[at] - first[at]).astype(np.uint64))
        offset[named] = start[at] - a[named]
    around = np.where(anchor >= 0, mixed(around + offset.astype(np.uint64)), 0)
    return key, around, a, b


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _chunks(texts: list[bytes | None]) -> Iterator[slice]:
    """Neighbouring documents with about CHUNK words together."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"") // 6
        if size >= CHUNK or k == len(texts) - 1:
            yield slice(at, k + 1)
            at, size = k + 1, 0


ENTRIES = "doc long, hash long, keys array<long>, arounds array<long>, firsts array<int>, lasts array<int>"


def _entries(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        powers = Powers()
        for batch in batches:
            texts = list(utf8(batch["text"]))
            for part in _chunks(texts):
                words = Words(texts[part], memo, powers)
                key, around, a, b = entries(words, window)
                doc = np.searchsorted(words.starts, a, "right") - 1
                offsets = np.searchsorted(doc, np.arange(len(words.counts) + 1))
                origin = words.starts[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc"][part.start : part.stop],
                        batch["hash"][part.start : part.stop],
                        _lists(offsets, key.view(np.int64), pa.int64()),
                        _lists(offsets, around.view(np.int64), pa.int64()),
                        _lists(offsets, (a - origin).astype(np.int32), pa.int32()),
                        _lists(offsets, (b - origin).astype(np.int32), pa.int32()),
                    ],
                    names=["doc", "hash", "keys", "arounds", "firsts", "lasts"],
                )

    return run


def _window_hashes(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        powers = Powers()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for text, asked in zip(utf8(batch["text"]), batch["asked"].to_pylist(), strict=True):
                words = Words([text], memo, powers)
                first, last = (np.array([x[k] for x in asked], np.int64) for k in ("first", "last"))
                n = last - first + 1
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first, n) + offset + words.starts[0]
                for column, values in zip(columns, (*(np.repeat(np.array([x[k] for x in asked], np.int64), n) for k in ("key", "around", "copies")), offset, words.stretch(at, at + window).view(np.int64)), strict=True):
                    column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["key", "around", "copies", "off", "content"])

    return run


def _result(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, hashes, texts = [], [], [], []
            for text, spans in zip(utf8(batch["text"]), batch["spans"].to_pylist(), strict=True):
                words = space_words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for x in spans or ():
                    gone[x["first"]] += 1
                    gone[x["last"] + window] -= 1
                keep = np.cumsum(gone)[:-1] == 0 if words else np.zeros(0, bool)
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if spans else b" ".join(words)
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                hashes.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, hash, spans)``: for documents (by id and text hash) with repeated windows, spans of their starts."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select("doc", "hash", "text")
    found = materialize(keyed.mapInArrow(_entries(window), ENTRIES).withColumn("row", F.monotonically_increasing_id()), "entries")
    zipped = F.arrays_zip("keys", "arounds", "firsts", "lasts")
    each = found.select("row", F.explode(zipped).alias("e")).select("row", F.col("e.keys").alias("key"), F.col("e.arounds").alias("around"), F.col("e.firsts").alias("first"), F.col("e.lasts").alias("last"))
    names = materialize(each.groupBy("key").agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("differ")), "names")
    release(spark)
    known = materialize(each.join(names, "key"), "known")
    release(spark)
    differ = known.where("differ")
    kinds = differ.groupBy("key", "around").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "last")).alias("e"))
    asked = kinds.select(F.col("e.row").alias("row"), F.struct("key", "around", F.col("e.first").alias("first"), F.col("e.last").alias("last"), "copies").alias("x")).groupBy("row").agg(F.collect_list("x").alias("asked"))
    # equal rows (id and text) have equal entries: the first stands for all, also where an entry's first row is asked
    where = materialize(found.groupBy(F.col("doc").alias("__doc"), F.col("hash").alias("__hash")).agg(F.min("row").alias("row")), "rows")
    asked = asked.join(where, "row").drop("row")
    texts = keyed.join(asked, (keyed["doc"] == asked["__doc"]) & (keyed["hash"] == asked["__hash"])).select("text", "asked")
    contents = materialize(texts.mapInArrow(_window_hashes(window), "key long, around long, copies long, off long, content long"), "windows")
    release(spark)
    place = F.struct("key", "around", "off")
    # equal windows have equal anchors, and so equal keys
    again = contents.groupBy("key", "content").agg(F.max("copies").alias("c"), F.min(place).alias("lo"), F.max(place).alias("hi")).where("c > 1 or lo <> hi").select("key", "content")
    # written down, so that the join below deals out both sides anew and can split a passage that is everywhere
    offsets = materialize(contents.join(again, ["key", "content"], "left_semi").groupBy("key", "around").agg(F.collect_set("off").alias("offs")), "offsets")
    by_window = differ.join(offsets, ["key", "around"]).select("row", F.explode("offs").alias("o"), "first").select("row", (F.col("first") + F.col("o")).cast("int").alias("first")).withColumn("last", F.col("first"))
    whole = known.where("not differ").select("row", "first", "last")
    spans = whole.unionByName(by_window).join(where, "row").groupBy(F.col("__doc").alias("doc"), F.col("__hash").alias("hash")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = materialize(spans, "spans")
    discard(found, names, known, contents, offsets, where)
    release(spark)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: words, removed words, the kept text and its sha256."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(-1))).withColumn("hash", F.xxhash64("text"))
    spans = repeated(keyed, window).select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), "spans")
    joined = keyed.join(spans, (keyed["doc"] == spans["__doc"]) & (keyed["hash"] == spans["__hash"]), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_result(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
