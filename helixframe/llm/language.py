"""Language identification by compression with per-language raw-content dictionaries.

Each language's dictionary is at most ``DICTIONARY`` bytes of lower-cased
training text: pieces of ``PIECE`` bytes of at most ``FIT_ROWS`` documents a
language, in the order of a hash, so that long documents don't crowd out the
rest. A text is compressed with every dictionary in blocks of ``BLOCK`` bytes
(within a longer frame its own repetitions would outweigh the dictionary) and
belongs to the language whose frames are smallest together. Where the smallest
two differ by less than ``MARGIN`` of the smaller, or by less than ``LEAST``
bytes, the choice is narrow: the text's distinct words, compressed at the
strongest level, vote as well, and the sum of both sizes decides; the
``narrow`` column says so.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no training row has a language. Equal sizes go to the
language with more training documents, then to the first by code point. Null ids count as ids of the training folds; rows
without lang teach nothing; repeated rows get equal predictions. Other columns
are ignored. Of a very long text a task holds some copies, block by block compressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below, fold, small_batches, utf8

DICTIONARY = 64 << 10
PIECE = 256
FIT_ROWS = 400
BLOCK = 1024
LEVEL = 9
SLOW = 19
#: Compresses to next to nothing, and keeps a short text's frame from being stored without compression.
FILL = b" " * 64
MARGIN = 0.015
LEAST = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Languages:
    """One compressor a language, in the order in which they win ties; sizes of a text's frames."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = list(samples)
        self.fast = [self._compressor(samples[x], LEVEL) for x in self.names]
        self.slow = [self._compressor(samples[x], SLOW) for x in self.names]

    @staticmethod
    def _compressor(sample: bytes, level: int) -> zstandard.ZstdCompressor:
        # a dictionary object holds the tables of one level only
        dictionary = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, how much larger the second smallest frame is (0 to 1), and whether that was narrow."""
        if not self.names or not text or not _LETTER.search(string := text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, False
        lowered = string.lower().encode()
        blocks = [lowered[k : k + BLOCK] for k in range(0, len(lowered), BLOCK)]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in self.fast]
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        best, second = sorted(sizes)[:2]
        narrow = second - best < max(LEAST, MARGIN * best)
        if narrow:
            words = b" ".join(sorted(set(lowered.split())))
            parts = [words[k : k + BLOCK] for k in range(0, len(words), BLOCK)]
            sizes = [a + sum(len(c.compress(FILL + x)) for x in parts) for a, c in zip(sizes, self.slow, strict=True)]
            best, second = sorted(sizes)[:2]
        return self.names[sizes.index(best)], 1 - best / second, narrow


def fit(docs: DataFrame, dictionary: int = DICTIONARY, fit_rows: int = FIT_ROWS) -> dict[str, bytes]:
    """Dictionary bytes by language, from rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)).distinct()
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return {}
    rows = F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.col("lang"))
    train = train.where(below(F.xxhash64("doc_id"), fit_rows, rows))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the group limit keeps at most fit_rows rows a language and task before the shuffle
    picked = train.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= fit_rows).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), "__rank")
    chosen = docs.join(F.broadcast(picked), docs["doc_id"].cast("long").eqNullSafe(picked["__id"]) & (docs["lang"].cast("string") == picked["__lang"])).select(F.col("__lang").alias("lang"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"]), strict=True):
                lowered = (text or b"").decode("utf-8", "replace").lower().encode()
                mine = [lowered[k : k + PIECE] for k in range(0, len(lowered), PIECE)]
                langs += [lang] * len(mine)
                pieces += mine
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], names=["lang", "piece"])

    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    enough = chosen.mapInArrow(cut, "lang string, piece binary").distinct().withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= 2 * dictionary // PIECE)
    samples: dict[str, bytes] = {}
    for row in sorted(enough.collect(), key=lambda r: (r["lang"], r["k"])):  # bounded by the rank
        samples[row["lang"]] = samples.get(row["lang"], b"") + bytes(row["piece"])
    common = sorted(counts, key=lambda x: (-counts[x], x.encode()))
    return {lang: samples[lang][:dictionary] for lang in common if samples.get(lang, b"").strip()}


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, narrow`` for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # DICTIONARY bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)
        for batch in batches:
            found = [languages.predict(t) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "narrow"],
            )

    ids = F.col("doc_id")
    return docs.select(ids.cast("long").alias("doc_id"), (fold(ids) == 2).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, narrow boolean")


def language(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict every whole text's language."""
    return identify(docs, fit(docs))
