"""Token ids as Parquet list columns, read back selectively.

Documents are dealt by ranges of doc_id, sorted, and encoded with the
``tokenizers`` library. Each task writes its files through Spark's own Parquet
writer, so files commit atomically and a lost executor's task runs again. The
format: one row a document with ``doc_id``, ``part`` and ``seq`` (its place:
ascending parts, ascending rows inside), ``n_tokens`` and ``tokens``, a list of
ids. Version-2 data pages give the integer columns delta encoding; ``tokens``
gets a dictionary while ids repeat enough for one, row groups end at
``ROW_GROUP`` bytes and pages at ``PAGE`` bytes or ``PAGE_ROWS`` rows, and column
and offset indexes let a reader fetch the metadata alone, or the pages of a few
documents.

Byte-level BPE never merges across the places where its pre-tokenizer cuts, so
text is cut at those that are certain from the bytes around them, each distinct
piece is encoded once while a bounded memo holds it, and the pieces' ids are
joined. Pieces are looked up by a 64-bit hash, and every one is compared byte by
byte with the piece whose ids it gets; a stretch in which one differs is encoded
anew without hashes. The ids equal those of encoding the whole text; tests
compare both. The cut is made only for tokenizers whose
pre-tokenizer is the plain byte-level one; others, and texts that hold an added
token, are encoded whole.

Defined results: a null text counts as empty and has the end id alone; null ids
come first; rows with equal ids stand beside one another in the order of their
texts' hashes, and however many there are, ranges split them; an empty table
gives empty files; other columns are ignored. A text is encoded whole, so a task
holds its batch's texts and ids, about eight bytes for each of the text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE as _BASE
from .common import Powers, mixed, shared_dir, small_batches, utf8

END = 2
MEMO = 700_000
MEMO_BYTES = 96 << 20
ROW_GROUP = 32 << 20
PAGE = 256 << 10
PAGE_ROWS = 2000
WRITER = {
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(512 << 10),
    "compression": "zstd",
}
# Classes of bytes between which, or around which, it is known where the pre-tokenizer cuts: ASCII letters, digits
# and signs other than the apostrophe (which may begin a contraction). 0: not known.
_CLASS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 33 <= b <= 126 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)
_BYTE = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64)
SLICE = 1 << 19
LATELY = 60


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a pool one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - ends + size, size) + np.arange(total)]


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of some stretches as two numbers; bytes beyond a stretch's end are 0."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    return words[start] & _MASKS[np.minimum(size, 8)], words[start + 8 * (size > 8)] & _MASKS[np.clip(size - 8, 0, 8)]


def appended(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` from place n on; it grows by doubling."""
    if n + len(new) > len(held):
        held = np.concatenate((held[:n], np.zeros(max(n, len(new), 1024), held.dtype)))
    held[n : n + len(new)] = new
    return held


class Memo:
    """Bytes and ids of pieces, found by their 64-bit hash; on overflow only what was used lately stays.

    Of a piece the length and the first 16 bytes are kept as numbers; of a longer one all bytes too.
    """

    def __init__(self, most: int):
        self.most, self.now, self.n, self.n_ids, self.n_text = most, 0, 0, 0, 0
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending hashes, and which piece it is
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.used, self.at, self.bytes = (np.zeros(0, np.int32) for _ in range(5))
        self.pool, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Pieces of sorted hashes, -1 for those that aren't here."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.slot[at], -1)

    def _shrink(self) -> None:
        keep = self.used[: self.n] > self.now - (LATELY if self.n > self.most else LATELY // 8)
        places = np.flatnonzero(keep)
        long = np.where(self.bytes[places] > 16, self.bytes[places], 0)
        self.pool, self.text = self.ids(places), gathered(self.text, self.at[places], long)
        self.n, self.n_ids, self.n_text = len(places), len(self.pool), len(self.text)
        self.low, self.high, self.size, self.used, self.bytes = (x[places] for x in (self.low, self.high, self.size, self.used, self.bytes))
        self.start, self.at = (np.cumsum(x, dtype=np.int32) - x for x in (self.size, long.astype(np.int32)))
        mine = keep[self.slot]
        self.hash, self.slot = self.hash[mine], (np.cumsum(keep) - 1).astype(np.int32)[self.slot[mine]]

    def add(self, hashes: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> None:
        if not ids:
            return
        if self.n > self.most or 4 * self.n_ids + self.n_text > MEMO_BYTES:
            self._shrink()
        size, length = np.array([len(x) // 4 for x in ids]), np.array([len(x) for x in pieces])
        long = np.where(length > 16, length, 0)
        low, high = heads(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length)
        to = np.searchsorted(self.hash, hashes)
        self.hash, self.slot = np.insert(self.hash, to, hashes), np.insert(self.slot, to, np.arange(self.n, self.n + len(ids)))
        start, at = self.n_ids + np.cumsum(size) - size, self.n_text + np.cumsum(long) - long
        names = ("low", "high", "start", "size", "used", "at", "bytes")
        for name, new in zip(names, (low, high, start, size, np.full(len(ids), self.now), at, length), strict=True):
            setattr(self, name, appended(getattr(self, name), self.n, new))
        self.pool = appended(self.pool, self.n_ids, np.frombuffer(b"".join(ids), np.uint32))
        self.text = appended(self.text, self.n_text, np.frombuffer(b"".join(x for x in pieces if len(x) > 16), np.uint8))
        self.n, self.n_ids, self.n_text = self.n + len(ids), self.n_ids + int(size.sum()), self.n_text + int(long.sum())

    def ids(self, places: np.ndarray) -> np.ndarray:
        """All ids of some pieces one after another."""
        return gathered(self.pool, self.start[places], self.size[places])

    def spells(self, places: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bool:
        """Whether the pieces at ``places`` are the stretches of ``data``, byte by byte."""
        low, high = heads(data, starts, sizes)
        if not ((self.bytes[places] == sizes) & (self.low[places] == low) & (self.high[places] == high)).all():
            return False
        long = np.flatnonzero(sizes > 16)
        return bool((gathered(self.text, self.at[places[long]], sizes[long]) == gathered(data, starts[long], sizes[long])).all())


class Encoder:
    """Ids of whole texts, the end id included."""

    def __init__(self, path: str, end: int = END, memo: int = MEMO):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.memo = Memo(memo)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        # an added token may match across a space, or be part of a piece: texts that have one are encoded whole
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.after_space[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.line = vocabulary.get("\u010a", -1)
        self.powers = Powers(_BASE)

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, parts: list[str], size: int = 200) -> list[bytes]:
        """Ids of parts that each begin with a space: many in one text, told apart by tokens that begin with it."""
        texts = [parts[at : at + size] for at in range(0, len(parts), size)]
        out: list[bytes] = []
        for part, e in zip(texts, self.tokenizer.encode_batch_fast(["".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            starts = np.flatnonzero(self.after_space[ids])
            if len(starts) == len(part):
                flat, bounds = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                out += [flat[a:b] for a, b in pairwise(bounds)]
            else:
                out += self.encoded(part)
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Encode pieces; those that begin with a space, and bare letters, many at a time."""
        if not self.cuts:
            return self.encoded(pieces)
        after = [x for x in pieces if x[0] == " "]
        bare = [x for x in pieces if x[0] != " "]
        spaced, other = iter(self.spaced(after)), iter(self.lines(bare))
        return [next(spaced) if x[0] == " " else next(other) for x in pieces]

    def lines(self, parts: list[str], size: int = 200) -> list[bytes]:
        """Ids of parts without a space before them; letters are put on lines of their own in one text."""
        found = self.encoded([x for x in parts if not x.isalpha()])
        words, whole = [x for x in parts if x.isalpha()], iter(found)
        texts = [words[at : at + size] for at in range(0, len(words), size)]
        out: list[bytes] = []
        for part, e in zip(texts, self.tokenizer.encode_batch_fast(["\n".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
            if len(ends) == len(part):
                out += [ids[a:b].tobytes() for a, b in zip([0, *(x + 1 for x in ends[:-1])], ends, strict=True)]
            else:
                out += self.encoded(part)
        known = iter(out)
        return [next(known) if x.isalpha() else next(whole) for x in parts]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start: at each text; at single spaces and around single line ends between characters other
        than white space; and between letters, digits and signs. Only where all of that is certain from the bytes:
        ASCII, and the letters U+00C0..U+00FF, whose first byte is 0xC3.
        """
        first = offsets[:-1][np.diff(offsets) > 0]
        if not self.cuts or len(data) < 3:
            return first
        kind = _CLASS[data]
        lead = data == 0xC3
        lead[-1] = False
        at = np.flatnonzero(lead)
        letter = (data[at + 1] != 0x97) & (data[at + 1] != 0xB7)  # the signs for times and divided by
        kind[at[letter]] = kind[at[letter] + 1] = 1
        solid = (kind > 0) | (data == 39)
        inner = np.zeros(len(data), bool)  # not the first byte of a character
        inner[at + 1] = True
        prev, this = slice(None, -1), slice(1, None)
        cut = np.zeros(len(data), bool)
        cut[this] = (kind[prev] > 0) & (kind[this] > 0) & (kind[prev] != kind[this]) & ~inner[this]
        white = (data == 32) | (data == 10)
        alone = np.flatnonzero(white[1:-1] & solid[:-2] & solid[2:]) + 1
        doc = np.searchsorted(offsets, alone, "right") - 1
        alone = alone[(alone > offsets[doc]) & (alone + 1 < offsets[doc + 1])]
        cut[alone] = True
        line = alone[data[alone] == 10] + 1
        cut[line] = True
        if self.added:
            text = data.tobytes()
            for token in self.added:
                place = text.find(token)
                while place >= 0:
                    k = np.searchsorted(offsets, place, "right") - 1
                    cut[offsets[k] : offsets[k + 1]] = False
                    place = text.find(token, place + 1)
        cut[first] = True
        return np.flatnonzero(cut)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts data[offsets[i]:offsets[i + 1]] one after another, and how many each has."""
        a = self.starts(data, offsets)
        b = np.append(a[1:], offsets[-1])
        up, down = self.powers.to(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
        hashes = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        memo = self.memo
        memo.now += 1
        place = memo.find(distinct)
        new = np.flatnonzero(place < 0)
        memo.used[place[place >= 0]] = memo.now
        raw = data.tobytes()
        pieces = [raw[x:y] for x, y in zip(a[first[new]].tolist(), b[first[new]].tolist(), strict=True)]
        memo.add(distinct[new], pieces, self.learn([x.decode("utf-8", "replace") for x in pieces]))
        known = memo.find(distinct)
        place = known[which]
        if memo.spells(place, data, a, b - a):
            ids, size = memo.ids(place), memo.size[place]
        else:  # two pieces with one hash
            ids, size = self.unhashed([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        ends = np.concatenate(([0], np.cumsum(size)))
        counts = np.diff(ends[np.searchsorted(a, offsets)]) + 1
        out = np.empty(len(ids) + len(counts), np.uint32)
        last = np.cumsum(counts) - 1
        mask = np.ones(len(out), bool)
        mask[last] = False
        out[last], out[mask] = self.end, ids
        return out, counts

    def unhashed(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces one after another, and how many each has."""
        known = dict.fromkeys(pieces)
        known = dict(zip(known, self.learn([x.decode("utf-8", "replace") for x in known]), strict=True))
        found = [known[x] for x in pieces]
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for a list of texts, a bounded stretch of them at a time."""
        ids, counts, held, size = [], [], [], 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= SLICE or k == len(texts) - 1:
                x, n = self(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]))
                ids.append(x)
                counts.append(n)
                held, size = [], 0
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])


@lru_cache(maxsize=2)
def encoder_of(path: str, end: int) -> Encoder:
    """One encoder, with its memo, for all tasks of a worker."""
    return Encoder(path, end)


def _writer_task(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end)
        seq = 0
        for batch in batches:
            ids, counts = encoder.encode([t or b"" for t in utf8(batch["text"])])
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array(np.arange(seq, seq + len(counts)), pa.int64()), pa.array(counts, pa.int64()), tokens],
                names=["doc_id", "part", "seq", "n_tokens", "tokens"],
            )
            seq += len(counts)

    return encode


#: Bytes of the documents' files for one range, where that makes more ranges than the session's own number.
RANGE = 128 << 20
MOST_RANGES = 1_000_000
SCHEMA = "doc_id long, part int, seq long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, to: str, end: int = END) -> None:
    """Encode ``docs`` and write the token files below ``to``, ascending by doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    # as many ranges as the tables' own size asks for, by the statistics of the scan: no pass over the texts
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(size // RANGE, MOST_RANGES))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("__order", F.xxhash64("text")).repartitionByRange(n, "doc_id", "__order").sortWithinPartitions("doc_id", "__order").drop("__order").withColumn("part", F.spark_partition_id())
    ranged.mapInArrow(_writer_task(tokenizer, end), SCHEMA).write.options(**WRITER).parquet(to)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch["tokens"]
        where = tokens.offsets.to_numpy()
        flat = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
        counts = np.diff(where).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["seq"], pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: per document where its ids start, how many they are and their crc32."""
    small_batches(spark)
    read = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "seq", "tokens").mapInArrow(_digest, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")
    # metadata only: the list column's pages stay unread
    parts = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    starts = parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.withColumn("__before", before).join(starts, F.col("part") == F.col("__part")).select("doc_id", (F.col("__start") + F.col("__before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; row groups and pages that can't hold them are skipped."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "tokens")


def token_file(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    to = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, to, end)
    return token_index(docs.sparkSession, to)
