"""What the operators of this subpackage share.

Texts reach Python as Arrow buffers and are cut into words as UTF-8 bytes: the
patterns of the contracts name ASCII characters only, so a class over code
points and the same class over bytes (with 0x80-0xFF inside) select the same
words, and ``bytes.translate`` plus ``bytes.split`` replace a regular
expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loop import dropped as discard
from ..operators.loop import shared_dir
from ..operators.loop import written as materialize
from ..session import prepare

__all__ = ["discard", "materialize", "shared_dir"]

#: ``bytes.split()`` splits at exactly these: space and 0x09-0x0D.
SPACE_WORD = "[^\\x20\\x09-\\x0D]+"
#: After lower-casing A-Z: digits, a-z and everything outside ASCII.
ALNUM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return text.translate(_ALNUM).split() if text else []


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; none for null."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The values of a string or binary column as bytes, nulls as None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if not len(column):
        return
    _, where, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(view[offsets[i] : offsets[i + 1]]) if valid is None or valid[i] else None


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small when documents are long (a deployment's own setting wins), and importable code."""
    prepare(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


SMALL_ROWS = 1_000_000


def small(df: DataFrame, tag: str, most: int = SMALL_ROWS) -> DataFrame:
    """A short table of fixed-width columns, written down and counted: to be broadcast if it has at most ``most`` rows.

    Beyond that joins deal out both sides as usual.
    """
    kept = materialize(df, tag)
    return F.broadcast(kept) if kept.count() <= most else kept


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that nothing refers to any more.

    Its cleaner acts when the JVM collects garbage, which a driver with little
    to do may put off until disks are full.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever it has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, mod 4; remainder 2 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4


def below(hashed: Column, wanted: int, count: Column | int) -> Column:
    """Whether a row's 64-bit hash is among the smallest, generously twice ``wanted`` of ``count`` rows.

    Put before a sort or a window that takes the ``wanted`` rows with the smallest hashes, it bounds what reaches them.
    """
    share = F.lit(2.0 * wanted + 1000) / F.greatest(F.lit(count) if isinstance(count, int) else count, F.lit(1))
    return hashed.cast("double") / 2.0**64 + 0.5 <= share


def crc_fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 4


def stable_seed(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode())


def passed_on(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])


def stretches(texts: list[bytes | None], most: int) -> Iterator[slice]:
    """Neighbouring texts of about ``most`` bytes together; a longer one is alone."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        more = len(text or b"")
        if size and size + more > most:
            yield slice(at, k)
            at, size = k, 0
        size += more
    if at < len(texts):
        yield slice(at, len(texts))


def word_ids(each: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """An integer for each word of some documents, the words' document (by place), and the distinct words by integer."""
    flat = pa.array([w for words in each for w in words], pa.large_binary()).dictionary_encode()
    doc = np.repeat(np.arange(len(each)), [len(words) for words in each])
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, flat.dictionary


def word_hashes(words: Iterable[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words through a memo that the caller bounds."""
    words = list(words)
    try:
        return np.array([memo[w] for w in words], np.uint64)
    except KeyError:
        for w in set(words).difference(memo):
            memo[w] = hash64(w)
        return np.array([memo[w] for w in words], np.uint64)


def hash64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that neighbouring or structured values spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd number, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed.

    With prefix sums of values times powers, the polynomial hash of any stretch
    is one difference times one power of the inverse.
    """

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            both = []
            for factor in (self.base, self.inverse):
                step = np.full(n, factor, np.uint64)
                step[0] = 1
                both.append(np.multiply.accumulate(step))
            self.up, self.down = both
        return self.up, self.down
