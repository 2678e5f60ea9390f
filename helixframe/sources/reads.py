"""Sequence files as a data source of planned splits: FASTA and FASTQ, plain, gzip, and block gzip in many tasks.

``spark.read.format("sequence_reads").option("split_bytes", n).load(path)`` gives ``name, seq``. A
file is cut into ranges of ``split_bytes`` (of a block-gzip file, compressed ones); ordinary gzip is one range. A range
owns the records that start behind its first byte, up to and including the one that starts at its end, so each
record is read once, wherever blocks and lines end. A FASTQ record starts at a line with ``@`` whose second next
line starts with ``+`` and whose fourth is as long as its second; a quality line can't pass for one.
Qualities are never kept. Files are opened through Arrow's file systems (local, S3, GCS, HDFS), where executors can reach them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import prepare

SPLIT = 64 << 20
ROWS = 8192
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08\x04"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    kind: str  # plain, gzip or blocks
    quality: bool


def block_size(head: bytes) -> int | None:
    """The whole size of a gzip block by its extra field, if it has one."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = int.from_bytes(head[10:12], "little"), 12
    while at + 4 <= min(12 + extra, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _first_block(file: BinaryIO, start: int, size: int) -> int:
    """Where the first block at or behind ``start`` begins: two blocks in a row (or one and the file's end) make it sure."""
    file.seek(start)
    held = file.read(min(size - start, 1 << 18))
    at = held.find(MAGIC)
    while at >= 0:
        found = block_size(held[at : at + 64])
        if found and (start + at + found == size or block_size(held[at + found : at + found + 64])):
            return start + at
        at = held.find(MAGIC, at + 1)
    return size


def _chunks(file: BinaryIO, part: Range, size: int) -> Iterator[tuple[bytes, bool]]:
    """Plain bytes from the range's start on, beyond its end too, and whether a chunk begins within the range."""
    if part.kind == "plain":
        file.seek(part.start)
        at = part.start
        while at < size:
            inside = at < part.stop
            data = file.read(min(CHUNK, part.stop - at) if inside else CHUNK)
            yield data, inside
            at += len(data)
    elif part.kind == "gzip":
        file.seek(0)
        whole = zlib.decompressobj(31)
        while data := file.read(CHUNK):
            while data:
                yield whole.decompress(data), True
                data = whole.unused_data
                if data:  # another member
                    whole = zlib.decompressobj(31)
    else:
        at = _first_block(file, part.start, size)
        while at < size:
            file.seek(at)
            head = file.read(64)
            many = block_size(head)
            if not many:
                raise ValueError(f"{part.path}: no block at byte {at}")
            block = head + file.read(max(many - len(head), 0))
            yield zlib.decompress(block[:many], 31), at < part.stop
            at += many


def _lines(chunks: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[bytes, bool]]:
    """Lines, and whether they start within the range or just at its end."""
    rest, open_line = b"", True
    for data, inside in chunks:
        if not data:
            continue
        pieces = (rest + data).split(b"\n")
        own = open_line
        for piece in pieces[:-1]:
            yield piece.removesuffix(b"\r"), own
            own = inside
        # the last piece starts in this chunk; where it is empty, with the next one, which may lie behind the end
        rest, open_line = pieces[-1], own if len(pieces) == 1 else inside
    if rest:
        yield rest.removesuffix(b"\r"), open_line


def _quality_records(lines: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[tuple[str, str]]:
    held: list[tuple[bytes, bool]] = []
    if not first:
        next(lines, None)
    for line in lines:
        held.append(line)
        if len(held) == 4:
            (head, own), (seq, _), (plus, _), (quality, _) = held
            if head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(quality):
                if not own:
                    return
                yield head[1:].decode(), seq.decode()
                held = []
            else:
                held.pop(0)
                if head and own and first:
                    raise ValueError(f"not a record: {head[:60]!r}")


def _plain_records(lines: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[tuple[str, str]]:
    name, parts = None, []
    if not first:
        next(lines, None)
    for line, own in lines:
        if line.startswith(b">"):
            if name is not None:
                yield name, b"".join(parts).decode()
            if not own:
                return
            name, parts = line[1:].decode(), []
        elif name is not None:
            parts.append(line)
    if name is not None:
        yield name, b"".join(parts).decode()


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out = []
        for f in files:
            with store.open_input_file(f.path) as file:
                head = file.read(64)
            plain = f.path.removesuffix(".gz")
            kind = "plain" if head[:2] != b"\x1f\x8b" else "blocks" if block_size(head) else "gzip"
            # an empty range where nothing is to be cut
            step = max(f.size, 1) if kind == "gzip" else self.split
            out += [Range(f.path, a, min(a + step, f.size), kind, plain.endswith((".fastq", ".fq"))) for a in range(0, f.size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(part.path) as file:
            lines = _lines(_chunks(file, part, file.size()))
            records = (_quality_records if part.quality else _plain_records)(lines, part.start == 0)
            rows: list[tuple[str, str]] = []
            for row in records:
                rows.append(row)
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    names, seqs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string())], names=["name", "seq"])


class SequenceReads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequence_reads"

    def schema(self) -> str:
        return "name string, seq string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT)))


def load_reads(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """``name, seq`` of FASTA or FASTQ files by planned splits; names that start with ``false`` go."""
    prepare(spark).dataSource.register(SequenceReads)
    found = spark.read.format("sequence_reads").option("split_bytes", split_bytes).load(path)
    return found.where("not startswith(name, 'false')")
