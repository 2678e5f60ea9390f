"""Mixing sources to target weights by balanced sampling with the cube method.

A document of a source whose target is ``e`` times its size is taken
``floor(e)`` times for certain and once more with inclusion probability
``e - floor(e)``. The cube method's flight phase moves those probabilities to
0 or 1 through the null space of the balancing constraints (document count and
token count), so both totals of a source stay what they were expected to be.
Any three fractional documents leave one direction of that null space: the
cross product of ``(1, 1, 1)`` and their sizes.

It is distributed as a tournament: a source's documents are dealt by a hash of
id and size into blocks of about ``BLOCK``, each block flies until at most two
documents are fractional, and these survivors meet in the next round. A block
that many rows with one id and size have filled to over four times that is dealt
once more by row number, so a block is bounded whatever ids there are. Only (row, size)
travels, never a text. When a source's survivors fit one block, its landing
rounds the last two so that the token total comes nearest.

Sizes are words between ASCII white space. Sources are ordered by code point,
null last, and weigh 3, 1, 2, repeating. Targets fill 150 % of all words, but
stop at twice a source's size, the excess being shared anew by weight.

Defined results: a null or empty text has size 0 and is taken for 0 words; a
source of size 0 has target 0; null ids and repeated rows are rows like any
other (equal rows are told apart by the round's draw alone); an empty table
gives an empty result. Draws depend on ids and sizes only (on row numbers where
thousands of rows share both), so reruns agree. Of a text only its size travels.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, fresh, materialize, small_batches, stable_seed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` with each source's ``target``.

    Sharing the excess until none is above its limit is water-filling: with
    sources ordered by limit over weight, the first k are full and the others
    get what is left by weight; k is the first at which the next isn't filled.
    One row a source, so the ordered windows run over a short table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.lit(most) * F.col("source_size")
    weighed = sources.withColumn("__w", F.get(F.array(*map(F.lit, weights)).cast("array<double>"), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    by_level = Window.orderBy(limit / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(whole)
    levels = weighed.withColumn("__level", (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    # the level of the first source that isn't filled; where all are, no limit
    last = F.min(F.when(F.col("__level") * F.col("__w") < limit, F.struct(limit / F.col("__w"), "__level"))).over(whole)["__level"]
    levels = levels.withColumn("__at", last)
    return levels.select("source", "source_size", F.coalesce(F.least(limit, F.col("__at") * F.col("__w")), limit).cast("double").alias("target"))


def fly(chances: list[float], sizes: list[float], draw: random.Random) -> None:
    """Move ``chances`` in place until at most two are fractional, keeping sum(chance) and sum(chance * size)."""
    eps = 1e-9
    held: list[int] = []
    for new in range(len(chances)):
        if not eps < chances[new] < 1 - eps:
            chances[new] = float(round(chances[new]))
            continue
        held.append(new)
        if len(held) < 3:
            continue
        i, j, k = held
        u = (sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i])
        if not any(u):  # equal sizes: two of them may trade
            u = (1.0, -1.0, 0.0)
        up = min((1 - chances[x]) / v if v > 0 else chances[x] / -v for x, v in zip(held, u, strict=True) if v)
        down = min(chances[x] / v if v > 0 else (1 - chances[x]) / -v for x, v in zip(held, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for x, v in zip(held, u, strict=True):
            chances[x] += step * v
        rest = []
        for x in held:
            if eps < chances[x] < 1 - eps:
                rest.append(x)
            else:
                chances[x] = float(round(chances[x]))
        held = rest


def land(chances: list[float], sizes: list[float]) -> None:
    """Round the last fractional chances so that the token total is nearest to what is expected."""
    left = [i for i, c in enumerate(chances) if 0 < c < 1]
    expected = sum(chances[i] * sizes[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(sizes[i] for b, i in enumerate(left) if m >> b & 1) - expected), bin(m).count("1"), m))
    for b, i in enumerate(left):
        chances[i] = float(best >> b & 1)


COLUMNS = "row long, doc_id long, source string, size long, source_size long, target double, chance double"


def _round(level: int):
    def play(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "size"], kind="stable", na_position="first")
        draw = random.Random(stable_seed(level, block["source"].iloc[0], block["__block"].iloc[0], block["__part"].iloc[0]))
        order = list(range(len(block)))
        draw.shuffle(order)
        chance, size = block["chance"].tolist(), block["size"].astype(float).tolist()
        flown, sizes = [chance[i] for i in order], [size[i] for i in order]
        fly(flown, sizes, draw)
        if block["__blocks"].iloc[0] == 1 and block["__parts"].iloc[0] == 1:
            land(flown, sizes)
        for i, c in zip(order, flown, strict=True):
            chance[i] = c
        return block.assign(chance=chance)[["row", "doc_id", "source", "size", "source_size", "target", "chance"]]

    return play


def _split(dealt: DataFrame, block: int) -> DataFrame:
    """Blocks with ``__part`` of ``__parts``: more than one where rows with one id and size have overfilled a block."""
    full = dealt.groupBy(F.col("source").alias("__o"), F.col("__block").alias("__b")).agg(F.count("*").alias("__rows")).where(F.col("__rows") > 4 * block)
    full = materialize(full, "overfull")
    if full.isEmpty():
        return dealt.withColumn("__parts", F.lit(1).cast("long")).withColumn("__part", F.lit(0).cast("long"))
    parts = F.ceil(F.coalesce("__rows", F.lit(1)) / block)
    joined = dealt.join(full, dealt["source"].eqNullSafe(full["__o"]) & (dealt["__block"] == full["__b"]), "left").withColumn("__parts", parts)
    return joined.withColumn("__part", F.pmod(F.xxhash64("row"), F.col("__parts"))).drop("__o", "__b", "__rows")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Per row: its size, its source's size and target, and ``taken``, the words the mix takes of it, repeats counted."""
    small_batches(docs.sparkSession)
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size")).withColumn("row", F.monotonically_increasing_id()),
        "mixture",
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    counted = totals.select("source", "source_size")
    # written down, its size is known when the join is planned: a short list of sources needs no shuffle of the rows
    plan = materialize(targets(counted, weights, share, most).withColumnRenamed("source", "__source"), "targets")
    known = rows.join(plan, rows["source"].eqNullSafe(plan["__source"])).drop("__source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(expected + 1e-12)
    state = known.withColumn("chance", F.greatest(expected - sure, F.lit(0.0)))
    done = []
    level = 0
    fractional = (F.col("chance") > 0) & (F.col("chance") < 1)
    while True:
        open_rows = state.where(fractional)
        left = open_rows.groupBy("source").agg(F.count("*").alias("__n")).withColumnRenamed("source", "__s")
        left = materialize(left.withColumn("__blocks", F.ceil(F.col("__n") / block)), "blocks")
        most_blocks = left.agg(F.max("__blocks")).first()[0]
        done.append(state.where(~fractional))
        if not most_blocks:
            break
        dealt = open_rows.join(left, open_rows["source"].eqNullSafe(left["__s"]))
        dealt = _split(dealt.withColumn("__block", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), F.col("__blocks"))), block)
        state = materialize(dealt.groupBy("source", "__block", "__part").applyInPandas(_round(level), COLUMNS), "mixture")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    taken = (F.round(F.col("chance")) + sure) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.coalesce(F.round(F.col("chance")) + sure, F.lit(0)).cast("int").alias("copies"), "source")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; all columns stay.

    Where ids are unique, copies find their rows by id. Where they aren't, rows are
    written down with a number that stands for the id, in the draws too.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    key, columns, drawn = docs["doc_id"].cast("long"), docs.columns, docs
    row, found, times, copy = fresh(docs, "row", "id", "copies", "copy")
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        key = docs[row]
        drawn = docs.select(key.alias("doc_id"), "source", "text")
    copies = mixture(drawn, weights, share, most).select(F.col("doc_id").alias(found), F.col("copies").alias(times))
    joined = docs.join(copies, key.eqNullSafe(copies[found])).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in columns))
