"""Exact nearest neighbours by a block matrix join on int8 tiles with error bounds.

Vectors are packed into blocks (a hash of the row's number deals them out, so
that one id on many rows fills many blocks), each row quantised to int8 by its
own scale. Only these tiles travel to where blocks of queries and candidates
meet. The product of two int8 matrices gives all approximate inner products of a
tile, and since x = X + e,

    |x.y - X.Y|  <=  |X| |e_y|  +  |e_x| |y|

with the norms kept beside the tile. A pair survives when its upper bound reaches
the k-th best of the query's lower bounds so far. Surviving pairs of all groups
are pruned once more by the query's k-th best lower bound of all, fetch their
original vectors, are computed again in double precision, and merged by heaps of
k. The result is exact: nothing below the bounds can belong to the k nearest.

Equal vectors tie everywhere, and ties go to the smaller id. So of candidates
with one vector a tile, and a query's survivors, keep those on the k + 1 smallest
ids (k rows an id): the others come after k nearer ones for every query. A vector
on a third of all rows then costs its rows once and no more.

Queries are a stated set (ids divisible by ``EVERY``) against all rows, in
blocks. A group is one query block and a run of candidate blocks, which stream
past it, so a task holds two tiles and its survivors, however long the run. Runs
have at most ``RUN_ROWS`` rows, and there are enough of them to keep the session's
cores busy; as many for any table that one query block serves, so survivors grow
with the queries. Blocks have at most ``BLOCK`` rows and ``TILE_BYTES`` of double
precision.

Integers up to 127 are multiplied as float32, which is exact below 2**24 (1040
dimensions); longer vectors use float64.

Defined results: vectors that are null or zero, or hold null or non-finite
components, and rows with a null id take no part, as queries or candidates.
Shorter vectors count as filled up with zeros. Rows that share an id are that
many candidates for others; a query never meets its own id, and a query id that
stands on several rows is asked once for each different vector. Ties go to the
smaller id. An empty table gives an empty result; fewer candidates than k give
all of them. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, utf8

K = 20
EVERY = 20
BLOCK = 4096
TILE_BYTES = 8 << 20
RUN_ROWS = 2 << 20
TASKS_A_CORE = 2
MOST_PARTS = 20_000
TILE = "block int, width int, ids binary, rows binary, prints binary, small binary, stats binary"


class Tile:
    """Vectors of one block: ids, row numbers, a fingerprint of each vector, int8 values, scales and norms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, prints: np.ndarray, small: np.ndarray, stats: np.ndarray):
        self.ids, self.rows, self.prints, self.small = ids, rows, prints, small
        self.scale, self.rounded_norm, self.rest_norm, self.norm = stats

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> Tile:
        scale = np.abs(vectors).max(1, keepdims=True) / 127
        small = np.rint(vectors / scale).astype(np.int8)
        rounded = small * scale
        stats = np.stack([scale[:, 0], np.linalg.norm(rounded, axis=1), np.linalg.norm(vectors - rounded, axis=1), np.linalg.norm(vectors, axis=1)])
        prints = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors), "V16")
        return cls(ids, rows, prints, small, stats)

    def columns(self) -> list[bytes]:
        stats = np.stack([self.scale, self.rounded_norm, self.rest_norm, self.norm])
        return [x.tobytes() for x in (self.ids, self.rows, self.prints, self.small, stats)]

    @classmethod
    def read(cls, width: int, ids: bytes, rows: bytes, prints: bytes, small: bytes, stats: bytes) -> Tile:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(prints, "V16"), np.frombuffer(small, np.int8).reshape(-1, width), np.frombuffer(stats).reshape(4, -1))


def leading(who: np.ndarray, prints: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of those that can be among the k nearest of a query ``who``: of equal vectors the k + 1 smallest ids, k rows each."""
    if not len(ids):
        return np.zeros(0, np.int64)
    _, vector = np.unique(prints, return_inverse=True)
    order = np.lexsort((ids, vector, who))
    w, v, i = who[order], vector[order], ids[order]
    fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])))  # another vector
    other = fresh | np.concatenate(([True], i[1:] != i[:-1]))  # another id
    at = np.arange(len(order))
    n_rows = at - np.maximum.accumulate(np.where(other, at, 0))
    count = np.cumsum(other)
    n_ids = count - np.maximum.accumulate(np.where(fresh, count, 0))
    return np.sort(order[(n_ids <= k) & (n_rows < k)])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, component after component."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Search:
    """Survivors of one query block, and its queries' best lower bounds."""

    def __init__(self, queries: Tile, k: int):
        self.q, self.k = queries, k
        self.lows = np.full((len(queries.ids), k), -np.inf)  # the k best, in any order
        self.found: list[tuple[np.ndarray, ...]] = []  # query, lower, upper bound, vector, id, row
        self.size = 0

    def meet(self, c: Tile) -> None:
        q = self.q
        width = max(q.small.shape[1], c.small.shape[1])
        kind = np.float32 if width * 127 * 127 < 2**24 else np.float64
        fill = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(kind)
        qs, cs = fill(q.small), fill(c.small)
        for at in range(0, len(qs), 256):
            part = slice(at, at + 256)
            near = (qs[part] @ cs.T).astype(np.float64) * q.scale[part, None] * c.scale[None]
            slack = q.rounded_norm[part, None] * c.rest_norm[None] + q.rest_norm[part, None] * c.norm[None]
            slack = slack * (1 + 1e-9) + 1e-12 * q.norm[part, None] * c.norm[None]  # rounding of the sums themselves
            own = q.ids[part, None] == c.ids[None]
            low, high = np.where(own, -np.inf, near - slack), near + slack
            n = low.shape[1]
            best = np.concatenate([self.lows[part], low if n <= self.k else np.partition(low, n - self.k, axis=1)[:, n - self.k :]], axis=1)
            self.lows[part] = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
            who, which = np.nonzero((high >= self.lows[part].min(1)[:, None]) & ~own)
            self.found.append((who + at, low[who, which], high[who, which], c.prints[which], c.ids[which], c.rows[which]))
            self.size += len(who)
        if self.size > 16 * self.k * len(q.ids) + 100_000:
            self.prune()

    def prune(self) -> None:
        who, low, high, prints, ids, rows = (np.concatenate(x) for x in zip(*self.found, strict=True))
        some = np.flatnonzero(high >= self.lows.min(1)[who])
        some = some[leading(who[some], prints[some], ids[some], self.k)]
        self.found = [tuple(x[some] for x in (who, low, high, prints, ids, rows))]
        self.size = len(some)

    def survivors(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self.prune()
        who, low, high, _, ids, rows = self.found[0]
        for at in range(0, len(who), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part], pa.int64()) for x in (self.q.ids[who], self.q.rows[who], ids, rows)), *(pa.array(x[part], pa.float64()) for x in (low, high))], names=["query_id", "query_row", "vec_id", "row", "low", "high"])


SURVIVORS = "query_id long, query_row long, vec_id long, row long, low double, high double"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as bytes of doubles."""
    for batch in batches:
        ids, packed = [], []
        for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_numpy(zero_copy_only=False), strict=True):
            if i is None or v is None or not len(v):
                continue
            try:
                x = np.asarray(v, np.float64)
            except TypeError:  # a null component
                continue
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                packed.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "packed"])


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.pad(np.frombuffer(x, np.float64), (0, width - len(x) // 8)) for x in packed])


def _tiles(k: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A block as one row; with k without rows that can't be among the k nearest."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = [bytes(x) for x in pdf["packed"]]
        width = max(map(len, packed)) // 8
        vectors = _matrix(packed, width)
        ids, rows = pdf["vec_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
        if k is not None:
            some = leading(np.zeros(len(ids), np.int64), np.ascontiguousarray(vectors).view(f"V{8 * width}")[:, 0], ids, k)
            ids, rows, vectors = ids[some], rows[some], vectors[some]
        return pd.DataFrame([[int(pdf["block"].iloc[0]), width, *Tile.of(ids, rows, vectors).columns()]], columns=["block", "width", "ids", "rows", "prints", "small", "stats"])

    return build


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate tiles stream past the query tile that comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            parts = zip(batch["kind"].to_pylist(), batch["width"].to_pylist(), *(utf8(batch[c]) for c in ("ids", "rows", "prints", "small", "stats")), strict=True)
            for kind, *columns in parts:
                if kind == 0:
                    if search:
                        yield from search.survivors()
                    search = Search(Tile.read(*columns), k)
                elif search:
                    search.meet(Tile.read(*columns))
        if search:
            yield from search.survivors()

    return run


def _scores(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of the original vectors, the k best of each query by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}  # (score, -id), the worst first
        for batch in batches:
            if not len(batch):
                continue
            left, right = (list(utf8(batch[c])) for c in ("asked", "packed"))
            width = max(map(len, left + right)) // 8
            for q, i, s in zip(batch["query_id"].to_pylist(), batch["vec_id"].to_pylist(), dot(_matrix(left, width), _matrix(right, width)).tolist(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        flat = [(q, -i, s) for q, heap in heaps.items() for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, run_rows: int = RUN_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest by inner product."""
    spark = embeddings.sparkSession
    small_batches(spark)
    packed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_pack, "vec_id long, packed binary")
    valid = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = valid.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "packed"])
    shape = valid.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("asked"), F.max(F.octet_length("packed")).alias("bytes")).first()
    block = max(min(block, TILE_BYTES // (shape["bytes"] or 8)), 1)
    query_blocks = -(-shape["asked"] // block) or 1
    busy = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    groups = min(max(-(-shape["n"] // run_rows), -(-busy // query_blocks)), max(shape["n"], 1))
    blocks = groups * (-(-shape["n"] // (groups * block)) or 1)
    parts = min(query_blocks * groups, MOST_PARTS)

    def tiled(rows: DataFrame, n: int, keep: int | None) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).groupBy("block").applyInPandas(_tiles(keep), TILE)

    # each candidate tile goes to its run once for every query block, each query tile to every run
    candidates = tiled(valid, blocks, k).withColumn("kind", F.lit(1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("g", F.pmod("block", F.lit(groups)))
    queries = tiled(asked, query_blocks, None).withColumn("kind", F.lit(0)).withColumn("q", F.col("block")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = candidates.unionByName(queries).withColumn("part", F.pmod(F.col("q") * groups + F.col("g"), F.lit(parts)).cast("int"))
    met = met.repartitionById(parts, F.col("part")).sortWithinPartitions("q", "g", "kind", "block")
    survivors = met.select("kind", "width", "ids", "rows", "prints", "small", "stats").mapInArrow(_search(k), SURVIVORS)
    each = Window.partitionBy("query_row").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of a query with under k survivors all stay
    left = survivors.withColumn("floor", F.nth_value("low", k).over(each)).where("floor is null or high >= floor").select("query_id", "query_row", "vec_id", "row")
    exact = left.join(valid.select("row", "packed"), "row").join(asked.select(F.col("row").alias("query_row"), F.col("packed").alias("asked")), "query_row")
    found = exact.select("query_id", "vec_id", "asked", "packed").mapInArrow(_scores(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
