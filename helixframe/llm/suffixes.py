"""Suffix-array dedup of byte strings: sorted, sampled suffixes find every string that starts earlier somewhere.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier: in a document with a smaller id, or further to the left in the same one.

Not every suffix is sorted, only those at *anchors*: of the 32-byte grams in a
string of ``length`` bytes the one with the smallest hash, leftmost in ties. Equal strings
have equal anchors at equal offsets, so comparing suffixes at anchors, to the
right and to the left, compares all strings; anchors are about one for 35 bytes.

1. *Which suffixes have a partner.* A task counts the grams at its anchors; a gram it has once
   is dealt by hash with its place, one it has more often as a count. Anchors whose gram
   stands anywhere else go on, with the strings they serve.
2. *Suffix sort.* Each such anchor's bytes (up to ``length`` to the right, what
   its strings reach to the left) are cut from the text. Of equal ones a task keeps the earliest and
   settles the others at once, so a passage in a third of all documents is a few
   rows a task. The rest are range-partitioned by their leading bytes, by splitters from a
   sample of documents (it decides on balance alone). A bucket is sorted by
   multikey quicksort on eight-byte words, the suffixes to the right and, reversed, what stands before them;
   neighbours' common prefixes give, for each offset, classes of equal strings, of
   which all but the earliest are repeats. All suffixes with one gram share 32 leading bytes and the splitters are 24
   bytes long, so no string has partners across a bucket's boundary.
3. *Hot grams.* Where over ``limit`` anchors share a gram (a passage that stands everywhere, each
   time in other surroundings), their strings are dealt one by one, by a hash of the whole string,
   after equal ones of a task were settled. No bucket holds more than ``limit`` suffixes of one gram.
4. Spans of repeats are gathered by row and cut from the texts.

Rows are written down once, compressed, with a number of their own, which is what travels.
Candidates are compared byte by byte; hashes only propose. Long texts are
searched in overlapping pieces.

Defined results: null is empty text, with nothing to remove; rows with one id (or
none, which come last) count as documents in the order of the table, so of equal rows one keeps its bytes;
texts under ``length`` bytes stay whole; what is left may not be valid UTF-8 and is
returned as bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, discard, materialize, mixed, release, small_batches, utf8

LENGTH = 100
GRAM = 32
HEAD = 24
PIECE = 1 << 19
HELD = 1 << 21
CUT = 100_000
LIMIT = 10_000
SAMPLE = 2000
LAST = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFF)

Batches = Iterator[pa.RecordBatch]


def _compressed(batches: Batches) -> Batches:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [t or b"" for t in utf8(batch["text"])]
        yield _batch(row=batch["row"], doc_id=batch["doc_id"], size=pa.array([len(t) for t in texts], pa.int64()), packed=pa.array([squeeze.compress(t) for t in texts], pa.binary()))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    whole = zstandard.ZstdDecompressor()
    return [whole.decompress(x) for x in batch["packed"].to_pylist()]


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Gram hash, place, and first and last string start of each anchor of the documents in ``data`` (under a million bytes)."""
    n = len(data)
    many = np.maximum(sizes - length + 1, 0)
    if not many.sum():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    up, down = powers.to(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.frombuffer(data, np.uint8) * up[:n])))
    name = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = (name & ~_LOW) | np.arange(len(name), dtype=np.uint64)
    width, wide = 1, length - GRAM + 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if wide > width:
        low = np.minimum(low[: width - wide], low[wide - width :])
    s = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = (low[s] & _LOW).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1))))
    place = at[fresh]
    return name[place], place, s[fresh], s[np.append(fresh[1:], len(s)) - 1]


def pieces(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts (or overlapping parts of long ones) of about PIECE bytes together: number, offset, bytes."""
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text or b"") - length + 1, 0), PIECE):
            part = text[at : at + PIECE + length - 1]
            if held and held + len(part) > PIECE:
                yield group
                group, held = [], 0
            group.append((k, at, part))
            held += len(part)
    if group:
        yield group


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A place and how far before it the first and the last string start, in one number."""
    return (place << 14) | ((place - first) << 7) | (place - last)


def _unpacked(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spots >> 14, (spots >> 7) & 127, spots & 127


def _lists(groups: np.ndarray, many: int, *columns: np.ndarray) -> list[pa.Array]:
    """Columns, ordered by group, as one list a group."""
    offsets = pa.array(np.searchsorted(groups, np.arange(many + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


GRAMS = "bucket int, keys array<long>, times array<long>, rows array<long>, spots array<long>"


def _grams(length: int, buckets: int) -> Callable[[Batches], Batches]:
    """Grams that a task has once with their place, others as a count; the places of the latter come along, as they have partners."""

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, row, spot = (np.concatenate(x) for x in zip(*held, strict=True))
        names, at, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        bucket = (names >> np.uint64(32)).astype(np.int64) % buckets
        once = times == 1
        order = np.argsort(bucket, kind="stable")
        own = np.where(once, row[at], -1)[order]
        asked = [names.view(np.int64)[order], times[order], own, np.where(once, spot[at], 0)[order]]
        known = ~once[back]
        filled, group = np.unique(bucket[order], return_inverse=True)
        columns = _lists(group, len(filled), *asked)
        none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))
        passed = [pa.ListArray.from_arrays(pa.array([0, int(known.sum())], pa.int32()), pa.array(x[known])) for x in (row, spot)]
        columns = [pa.concat_arrays([c, more]) for c, more in zip(columns, (none, none, *passed), strict=True)]
        # what needs no partner goes to any bucket
        turn = int(mixed(names[:1])[0] % np.uint64(buckets))
        return _batch(bucket=pa.array([*filled.tolist(), turn], pa.int32()), keys=columns[0], times=columns[1], rows=columns[2], spots=columns[3])

    def run(batches: Batches) -> Batches:
        powers, held, size = Powers(), [], 0
        for batch in batches:
            rows = batch["row"].to_numpy()
            for group in pieces(_texts(batch), length):
                sizes = np.array([len(x[2]) for x in group])
                starts = np.cumsum(sizes) - sizes
                key, place, first, last = anchors(b"".join(x[2] for x in group), starts, sizes, length, powers)
                doc = np.searchsorted(starts, place, "right") - 1
                move = np.array([x[1] for x in group])[doc] - starts[doc]
                held.append((key, rows[np.array([x[0] for x in group])[doc]], _packed(place + move, first + move, last + move)))
                size += len(key)
                if size >= HELD:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    return run


def _by_row(row: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    order = np.argsort(row, kind="stable")
    names, group = np.unique(row[order], return_inverse=True)
    return [pa.array(names, pa.int64()), *_lists(group, len(names), *(c[order] for c in columns))]


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _partners(limit: int) -> Callable[[pa.Table], pa.Table]:
    """Places of grams that occur again, by row; without a row, the grams that occur over ``limit`` times."""

    def run(bucket: pa.Table) -> pa.Table:
        asked = bucket.filter(pa.compute.greater(pa.compute.list_value_length(bucket["keys"]), 0))
        passed = bucket.filter(pa.compute.equal(pa.compute.list_value_length(bucket["keys"]), 0))
        key, times, row, spot = (_flat(asked, c) for c in ("keys", "times", "rows", "spots"))
        names, back = np.unique(key, return_inverse=True)
        whole = np.bincount(back, weights=times, minlength=len(names))
        good = (whole[back] > 1) & (row >= 0)
        row, spots = _by_row(np.concatenate((row[good], _flat(passed, "rows"))), np.concatenate((spot[good], _flat(passed, "spots"))))
        often = names[whole > limit].tolist()
        hot = pa.array([often] if often else [], pa.list_(pa.int64()))
        return pa.table({"row": pa.concat_arrays([row, pa.nulls(len(hot), pa.int64())]), "spots": pa.concat_arrays([spots, hot])})

    return run


class Suffixes:
    """Anchors of some documents: document id, row, packed place, and a matrix of the bytes around, zeros beyond their strings."""

    def __init__(self, doc: np.ndarray, row: np.ndarray, spot: np.ndarray, bytes_: np.ndarray, length: int):
        self.doc, self.row, self.spot, self.bytes, self.length = doc, row, spot, bytes_, length
        self.place, self.most, self.least = _unpacked(spot)

    @classmethod
    def cut(cls, text: bytes, doc: int, row: int, spot: np.ndarray, length: int) -> Suffixes:
        place, most, least = _unpacked(spot)
        reach = np.arange(GRAM - length, length)
        at = place[:, None] + reach
        inside = (reach >= -most[:, None]) & (reach < length - least[:, None])
        held = np.frombuffer(text, np.uint8)[np.where(inside, at, 0)] * inside
        width = -held.shape[1] % 8
        return cls(np.full(len(spot), doc), np.full(len(spot), row), spot, np.pad(held, ((0, 0), (0, width))), length)

    @classmethod
    def joined(cls, parts: list[Suffixes]) -> Suffixes:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "row", "spot", "bytes")), parts[0].length)

    def __len__(self) -> int:
        return len(self.spot)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.doc[at], self.row[at], self.spot[at], self.bytes[at], self.length)

    def sums(self, seed: int) -> np.ndarray:
        words = self.bytes.view(np.uint64)
        salt = mixed(np.arange(1, words.shape[1] + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        return mixed((words * salt).sum(1) + (self.most * 128 + self.least).astype(np.uint64))

    def grams(self) -> np.ndarray:
        up, _ = Powers().to(GRAM)
        left = self.length - GRAM
        return mixed((self.bytes[:, left : left + GRAM] * up[:GRAM]).sum(1, dtype=np.uint64))

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of equal ones (bytes and strings) the first; and those that are settled by it."""
        one, two = self.sums(1), self.sums(2)
        order = np.lexsort((self.place, self.row, self.doc, two, one))
        head = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        rest = np.flatnonzero(~head)
        same = (self.bytes[order[rest]] == self.bytes[lead[rest]]).all(1)
        head[rest[~same]] = True  # equal sums alone settle nothing
        return order[head], order[~head]

    def single(self) -> Suffixes:
        """One for each string."""
        many = self.most - self.least + 1
        at = np.repeat(np.arange(len(self)), many)
        back = self.least[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        reach = np.arange(GRAM - self.length, GRAM - self.length + self.bytes.shape[1])
        inside = (reach >= -back[:, None]) & (reach < self.length - back[:, None])
        return Suffixes(self.doc[at], self.row[at], (self.place[at] << 14) | (back << 7) | back, self.bytes[at] * inside, self.length)


def multikey(rows: np.ndarray) -> np.ndarray:
    """The order of byte rows: by their first eight bytes, then group by group of equal ones by the next eight, while groups are left."""
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    at, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for depth in range(words.shape[1]):
        key = words[order[at], depth]
        split = np.lexsort((key, group))
        order[at] = order[at][split]
        key = key[split]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        tied = ~fresh | np.append(~fresh[1:], False)
        at, group = at[tied], group[tied]
        if not len(at):
            break
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in the order shares with the one before."""
    same = rows[order[1:]] == rows[order[:-1]]
    return np.where(same.all(1), rows.shape[1], same.argmin(1))


def repeats(found: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of strings that another of ``found`` holds earlier."""
    n, length = len(found), found.length
    left = length - GRAM
    right, before = found.bytes[:, left : left + length], found.bytes[:, :left][:, ::-1]
    orders = [multikey(x) for x in (right, before)]
    shared = [_common(x, o) for x, o in zip((right, before), orders, strict=True)]
    by_age = np.lexsort((found.place, found.row, found.doc))
    age = np.empty(n, np.int64)
    age[by_age] = np.arange(n)
    late = np.zeros((n, left + 3), bool)
    classes = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for back in range(left + 1):
        for side, (order, common, least) in enumerate(zip(orders, shared, (length - back, back), strict=True)):
            classes[side][order[1:]] = np.cumsum(common < least)
            classes[side][order[:1]] = 0
        has = np.flatnonzero((found.least <= back) & (back <= found.most))
        key = np.sort((classes[0][has] * n + classes[1][has]) * n + age[has])
        again = np.flatnonzero(key[1:] // n == key[:-1] // n) + 1
        late[by_age[key[again] % n], back + 1] = True
    turn = np.diff(late.astype(np.int8), axis=1)
    who, start = np.nonzero(turn == 1)
    stop = np.nonzero(turn == -1)[1]
    return found.row[who], found.place[who] - (stop - 1), found.place[who] - start


CUTS = "bucket int, rows array<long>, docs array<long>, spots array<long>, bytes binary, gone array<long>, firsts array<long>, lasts array<long>"


def _cuts(length: int, splitters: np.ndarray, hot: np.ndarray, buckets: int) -> Callable[[Batches], Batches]:
    left = length - GRAM

    def settled(found: Suffixes) -> tuple[Suffixes, tuple[np.ndarray, ...]]:
        first, other = found.earliest()
        gone = found.row[other], found.place[other] - found.most[other], found.place[other] - found.least[other]
        return found.take(np.sort(first)), gone

    def dealt(held: list[Suffixes]) -> Iterator[pa.RecordBatch]:
        found, gone = settled(Suffixes.joined(held))
        yield from removed(gone)
        bucket = np.searchsorted(splitters, np.ascontiguousarray(found.bytes[:, left : left + HEAD]).view(f"S{HEAD}").ravel(), "right")
        if len(hot):
            apart = np.isin(found.grams().view(np.int64), hot)
            yield from sent(found.take(np.flatnonzero(~apart)), bucket[~apart])
            at = np.flatnonzero(apart)
            for part in np.array_split(at, -(-len(at) * (left + 1) // CUT)) if len(at) else ():
                alone, gone = settled(found.take(part).single())
                yield from removed(gone)
                yield from sent(alone, buckets + (alone.sums(3) % np.uint64(buckets)).astype(np.int64))
        else:
            yield from sent(found, bucket)

    def removed(gone: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        if len(gone[0]):
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in gone]
            none = pa.array([[]], pa.list_(pa.int64()))
            yield _batch(bucket=pa.array([int(gone[0][0] % buckets)], pa.int32()), rows=none, docs=none, spots=none, bytes=pa.array([b""], pa.binary()), gone=lists[0], firsts=lists[1], lasts=lists[2])

    def sent(found: Suffixes, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        none = pa.array([[]] * len(names), pa.list_(pa.int64()))
        if len(names):
            group = np.repeat(np.arange(len(names)), np.diff(np.append(at, len(order))))
            lists = _lists(group, len(names), *(x[order] for x in (found.row, found.doc, found.spot)))
            squeeze = zstandard.ZstdCompressor(level=1)
            cut = pa.array([squeeze.compress(found.bytes[x].tobytes()) for x in np.split(order, at[1:])], pa.binary())
            yield _batch(bucket=pa.array(names, pa.int32()), rows=lists[0], docs=lists[1], spots=lists[2], bytes=cut, gone=none, firsts=none, lasts=none)

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            rows, docs, spots = batch["row"].to_numpy(), batch["doc"].to_numpy(), batch["spots"]
            for k, text in enumerate(_texts(batch)):
                own = spots[k].values.to_numpy()
                for at in range(0, len(own), CUT):
                    held.append(Suffixes.cut(text, docs[k], rows[k], own[at : at + CUT], length))
                    size += len(held[-1])
                    if size >= CUT:
                        yield from dealt(held)
                        held, size = [], 0
        if size:
            yield from dealt(held)

    return run


def _sorted(length: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's repeats, and what tasks had settled, by row."""

    def run(bucket: pa.Table) -> pa.Table:
        out = [tuple(_flat(bucket, c) for c in ("gone", "firsts", "lasts"))]
        row, doc, spot = (_flat(bucket, c) for c in ("rows", "docs", "spots"))
        if len(row):
            whole = zstandard.ZstdDecompressor()
            held = np.frombuffer(b"".join(whole.decompress(x) for x in bucket["bytes"].to_pylist() if x), np.uint8).reshape(len(row), -1)
            found = Suffixes(doc, row, spot, held, length)
            first, other = found.earliest()
            out.append((found.row[other], found.place[other] - found.most[other], found.place[other] - found.least[other]))
            out.append(repeats(found.take(first)))
        gone = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table(dict(zip(("row", "firsts", "lasts"), _by_row(*gone), strict=True)))

    return run


def _result(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for k, text in enumerate(_texts(batch)):
                gone = np.zeros(len(text) + 1, bool)
                for span in batch["spans"][k].as_py() or ():
                    for a, b in zip(span["firsts"], span["lasts"], strict=True):
                        gone[a : b + length] = True
                kept = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()
                for column, x in zip(columns, (len(text), len(text) - len(kept), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            yield _batch(doc_id=batch["doc_id"], **{n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return run


def _splitters(texts: DataFrame, spots: DataFrame, rows: int, length: int, buckets: int) -> np.ndarray:
    """Leading bytes that cut the suffixes of a sample of about ``SAMPLE`` documents, 50 of each, into equal parts."""

    def heads(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for k, text in enumerate(_texts(batch)):
                out += [text[p : p + HEAD] for p in (batch["spots"][k].values.to_numpy() >> 14).tolist()]
            yield _batch(head=pa.array(out, pa.binary()))

    few = F.filter("spots", lambda _, i: i % F.ceil(F.size("spots") / 50) == 0)
    some = spots.where(F.pmod(F.xxhash64("row"), F.lit(max(1, rows // SAMPLE))) == 0).select("row", few.alias("spots"))
    found = texts.join(F.broadcast(some), "row").select("packed", "spots").mapInArrow(heads, "head binary").collect()
    sample = np.sort(np.array([bytes(r["head"]) for r in found], f"S{HEAD}"))
    return np.unique(sample[np.linspace(0, len(sample), buckets + 1)[1:-1].astype(np.int64)]) if len(sample) else sample


def suffix_dedup(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of all rows; ``length`` is from 33 to 128 bytes."""
    if not GRAM < length <= 128:
        raise ValueError(f"length has to be over {GRAM} and 128 at most")
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = keyed.withColumn("row", F.monotonically_increasing_id())
    texts = materialize(numbered.mapInArrow(_compressed, "row long, doc_id long, size long, packed binary"), "texts")
    size = texts.agg(F.sum("size")).first()[0] or 0
    buckets = max(64, size >> 25)
    # at most a million grams are hot, whatever the size
    hot_from = max(limit, size // (35 * 1_000_000))
    asked = texts.select("row", "packed").mapInArrow(_grams(length, buckets), GRAMS)
    found = materialize(asked.groupBy("bucket").applyInArrow(_partners(hot_from), "row long, spots array<long>"), "partners")
    release(spark)
    hot = np.array(sorted({k for r in found.where("row is null").collect() for k in r["spots"]}), np.int64)
    spots = materialize(found.where("row is not null").groupBy("row").agg(F.flatten(F.collect_list("spots")).alias("spots")), "spots")
    rows, n = spots.agg(F.count("*"), F.sum(F.size("spots"))).first()
    buckets = max(64, (n or 0) * 200 >> 26)
    splitters = _splitters(texts, spots, rows, length, buckets)
    served = texts.join(spots, "row").select("row", F.coalesce("doc_id", F.lit(int(LAST))).alias("doc"), "packed", "spots")
    cuts = served.mapInArrow(_cuts(length, splitters, hot, buckets), CUTS)
    gone = materialize(cuts.groupBy("bucket").applyInArrow(_sorted(length), "row long, firsts array<long>, lasts array<long>"), "repeats")
    discard(found, spots)
    release(spark)
    spans = materialize(gone.groupBy("row").agg(F.collect_list(F.struct("firsts", "lasts")).alias("spans")), "spans")
    discard(gone)
    release(spark)
    joined = texts.join(spans, "row", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_result(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
