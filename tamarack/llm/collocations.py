"""Phrase collocation mining (operator 12) by direct-address tiling.

Words are named by 62-bit hashes of language and word; the seed of the hash is changed until no two words of the corpus share a name. The most
frequent names get ids, their ranks. A pair of neighbouring ids (i, j) belongs to the tile (i // 512, j // 512). Frequent words have
small ids, so well-filled tiles lie in one corner: those are counted in dense arrays with ``bincount``; all other pairs are counted as
sorted coordinates. Partial counts of the tasks are summed on Spark. Frequent pairs are ranked again and get ids of their own, and pairs of
neighbouring pair ids are three-word phrases, pairs of those four-word ones: every level is the same count over the level before.

What is broadcast: at each level the ids of ``head`` names at most (8 bytes each), and, where more names are frequent, a filter of the others
of fixed size. Those others keep their 62-bit names instead of ids and are counted as coordinates, so none is lost; a name of a pair with
such a member is a hash of the two. Every part of a phrase that occurs ``least`` times occurs as often, so only frequent parts are kept.

Defined cases: a null text is empty; a null language is ``und``, as are rows that say so; repeated rows count each; phrases never cross
pieces or rows; a corpus without frequent phrases, or an empty table, gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, filter_bytes, stage
from ._shingles import mix

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
TOKEN = r"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+"
LEAST, LONGEST, TOP = 30, 4, 2_000
#: Ids of a level at most, and bits of the filter of further frequent names.
HEAD, TAIL_BITS = 1 << 19, 1 << 28
#: A tile has 512 x 512 cells; the corner of 32 x 32 tiles is looked at for well-filled ones, of which a task keeps 16 (32 MB).
TILE_BITS, CORNER, DENSE = 9, 32, 16
CELLS = 1 << (2 * TILE_BITS)
#: Positions that are counted together, and coordinates that a task holds before it gives them out.
BLOCK, HELD = 1 << 20, 1 << 22
DEAD = -1
_ID = 31


@dataclass(frozen=True)
class Names:
    """The ids of one level: keys in the order of their ids, and a filter of frequent keys without an id, or None."""

    keys: Broadcast
    tail: Broadcast | None


def tokens(text: Column) -> Column:
    """Words of a text and, between pieces, runs of separators."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _separates(token: Column) -> Column:
    return F.instr(F.lit(SEPARATORS), F.substring(token, 1, 1)) > 0


def _name(lang: Column, word: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(lang, word, F.lit(seed)), 2)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, n, key) of all words of docs (lang, text), and the seed with which no two of them share a key."""
    words = docs.select("lang", F.explode(tokens(F.col("text"))).alias("word")).filter(~_separates(F.col("word")))
    counted = stage(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    seed = 0
    while not counted.select(_name(F.col("lang"), F.col("word"), seed).alias("key")).groupBy("key").count().filter("count > 1").isEmpty():
        seed += 1
    return counted.withColumn("key", _name(F.col("lang"), F.col("word"), seed)), seed


def name_level(frequent: DataFrame, head: int, tail_bits: int) -> Names:
    """Ids of the ``head`` most frequent keys of frequent (key, n); the rest goes to a filter."""
    sc = frequent.sparkSession.sparkContext
    first = frequent.orderBy(F.col("n").desc(), "key").limit(head).select("key").toArrow()  # bounded by head
    keys = np.ascontiguousarray(first.column("key").to_numpy()).astype(np.int64)
    tail = sc.broadcast(filter_bytes(frequent, "key", tail_bits)) if frequent.count() > head else None
    return Names(sc.broadcast(keys), tail)


class Relabel:
    """Keys to values: an id, or the key made negative where the filter has it, or DEAD."""

    def __init__(self, names: Names):
        self.index = pd.Index(names.keys.value)
        self.tail = None if names.tail is None else np.frombuffer(names.tail.value, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        value = self.index.get_indexer(keys).astype(np.int64)
        if self.tail is not None:
            rest = np.flatnonzero((value < 0) & (keys != DEAD))
            slot = keys[rest] % (self.tail.size * 8)
            rest = rest[(self.tail[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            value[rest] = np.where(keys[rest] < 0, keys[rest], -keys[rest] - 2)
        return value


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of pairs of values: exact for two ids, a hash under -1 where one is no id, DEAD where one is DEAD."""
    keys = first << _ID | second
    named = np.flatnonzero((first < 0) | (second < 0))
    hashed = mix(first[named].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(second[named].astype(np.uint64)))
    keys[named] = -(hashed >> np.uint64(2)).astype(np.int64) - 2
    keys[named[(first[named] == DEAD) | (second[named] == DEAD)]] = DEAD
    return keys


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and where each row ends."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(offsets[1:] - offsets[0], np.int64)


def _as_lists(values: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(values))], ["values"])


def _pairs(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of each value and its right neighbour in the same row."""
    keys = pair_keys(values, np.append(values[1:], DEAD))
    keys[ends[ends > 0] - 1] = DEAD
    return keys


def _first_values(names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relabel = Relabel(names)
        for batch in batches:
            keys, ends = _lists(batch.column(0))
            yield _as_lists(relabel(keys), ends)

    return run


def _next_values(names: Names):
    """Values of one level to those of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relabel = Relabel(names)
        for batch in batches:
            values, ends = _lists(batch.column(0))
            yield _as_lists(relabel(_pairs(values, ends)), ends)

    return run


class Tiles:
    """Counts of pairs of values in one task."""

    def __init__(self):
        self.slot = np.full(CORNER * CORNER, -1)  # of each tile of the corner
        self.tiles: list[int] = []
        self.cells = np.zeros(0, np.int64)
        self.sparse: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        row, column = first >> TILE_BITS, second >> TILE_BITS
        near = (first >= 0) & (second >= 0) & (row < CORNER) & (column < CORNER)
        tile = row[near] * CORNER + column[near]
        if len(self.tiles) < DENSE:
            filled = np.bincount(tile, minlength=self.slot.size)
            for t in np.argsort(-filled, kind="stable")[: DENSE - len(self.tiles)]:
                if filled[t] * 8 >= CELLS and self.slot[t] < 0:
                    self.slot[t] = len(self.tiles)
                    self.tiles.append(int(t))
            self.cells = np.append(self.cells, np.zeros(len(self.tiles) * CELLS - self.cells.size, np.int64))
        slot = self.slot[tile]
        dense = slot >= 0
        if dense.any():
            low = CELLS.bit_length() - 1
            cell = (first[near][dense] & (1 << TILE_BITS) - 1) << TILE_BITS | second[near][dense] & (1 << TILE_BITS) - 1
            self.cells += np.bincount(slot[dense] << low | cell, minlength=self.cells.size)
        rest = np.ones(first.size, bool)
        rest[np.flatnonzero(near)[dense]] = False
        self._coordinates(first[rest], second[rest], np.ones(int(rest.sum()), np.int64))

    def _coordinates(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> None:
        self.sparse.append((first, second, n))
        self.held += first.size

    def merge(self) -> None:
        """Equal coordinates become one, in sorted order."""
        first, second, n = (np.concatenate(x) for x in zip(*self.sparse, strict=True)) if self.sparse else (np.zeros(0, np.int64),) * 3
        order = np.argsort(first << _ID | second) if not (first < 0).any() and not (second < 0).any() else np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: first.size]
        at = np.flatnonzero(new)
        self.sparse = [(first[at], second[at], np.add.reduceat(n[order], at) if at.size else n)]
        self.held = at.size

    def give(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        yield _counted(*self.sparse.pop())
        self.held = 0

    def dense(self) -> Iterator[pa.RecordBatch]:
        for k, tile in enumerate(self.tiles):
            part = self.cells[k * CELLS : (k + 1) * CELLS]
            at = np.flatnonzero(part)
            yield _counted((tile // CORNER << TILE_BITS) + (at >> TILE_BITS), (tile % CORNER << TILE_BITS) + (at & (1 << TILE_BITS) - 1), part[at])


def _counted(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (first, second, n)], ["first", "second", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, n): partial counts of the neighbouring values of a task's rows."""
    tiles, held, size = Tiles(), [], 0
    for batch in batches:
        values, ends = _lists(batch.column(0))
        if not values.size:
            continue
        second = np.append(values[1:], DEAD)
        second[ends[ends > 0] - 1] = DEAD
        both = (values != DEAD) & (second != DEAD)
        held.append((values[both], second[both]))
        size += held[-1][0].size
        if size >= BLOCK:
            tiles.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
            if tiles.held >= HELD:
                tiles.merge()
                if 2 * tiles.held >= HELD:
                    yield from tiles.give()
    if held:
        tiles.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
    yield from tiles.dense()
    yield from tiles.give()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "second"))
        yield batch.append_column("key", pa.array(pair_keys(first, second)))


def _valued(names: Names):
    """Rows (key ...) with the value of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relabel = Relabel(names)
        for batch in batches:
            value = relabel(batch.column("key").to_numpy().astype(np.int64))
            yield batch.append_column("value", pa.array(value))

    return run


def _with_values(frequent: DataFrame, names: Names) -> DataFrame:
    kinds = ", ".join(f"{c} {t}" for c, t in frequent.dtypes)
    return frequent.mapInArrow(_valued(names), f"{kinds}, value long")


def phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, tail_bits: int = TAIL_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of each length, and (lang, total) of all words.

    A level has value, first, second (values of the phrases without the last and without the first word), lang, phrase, last (word), n,
    heads and tails: the counts of its first and of its last 1, 2, ... words.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, seed = vocabulary(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = stage(words.filter(F.col("n") >= least), "frequent")
    names = name_level(frequent, head, tail_bits)
    here = _with_values(frequent, names).select("value", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("second"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = [stage(here, "level1")]
    keys = F.transform(tokens(F.col("text")), lambda w: F.when(_separates(w), F.lit(DEAD)).otherwise(_name(F.col("lang"), w, seed)))
    values = stage(docs.select(keys.alias("keys")).mapInArrow(_first_values(names), "values array<bigint>"), "values1")
    for size in range(2, longest + 1):
        # Keys follow from pairs: only pairs are shuffled.
        counts = values.mapInArrow(_count, "first long, second long, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
        frequent = stage(counts.filter(F.col("n") >= least).mapInArrow(_keyed, "first long, second long, n long, key long"), "frequent")
        names = name_level(frequent, head, tail_bits)
        before = levels[-1]
        left = before.select(F.col("value").alias("first"), "lang", F.col("phrase").alias("front"), "heads")
        right = before.select(F.col("value").alias("second"), "last", "tails")
        joined = _with_values(frequent, names).join(left, "first").join(right, "second")
        phrase = F.concat_ws(" ", "front", "last")
        levels.append(stage(joined.select("value", "first", "second", "lang", phrase.alias("phrase"), "last", "n", F.array_append("heads", F.col("n")).alias("heads"), F.array_append("tails", F.col("n")).alias("tails")), f"level{size}"))
        if size < longest:
            values = stage(values.mapInArrow(_next_values(names), "values array<bigint>"), f"values{size}")
    return levels, totals


def _scored(level: DataFrame, size: int) -> DataFrame:
    """The cut with the least score, of equal ones the first: product and quotient are decimals of 38 digits."""
    cuts = []
    for k in range(1, size):
        left, right = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
        score = F.expr(f"(CAST(n AS DECIMAL(28, 0)) * 2000000BD) div CAST(heads[{k - 1}] + tails[{size - k - 1}] AS DECIMAL(28, 0))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
    return level.withColumn("best", best)


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, head: int = HEAD, tail_bits: int = TAIL_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of docs (lang, text) by score, count and bytes."""
    levels, totals = phrases(docs, least=least, longest=longest, head=head, tail_bits=tail_bits)
    kept = []
    for size in range(2, longest + 1):
        level = _scored(levels[size - 1], size)
        if size < longest:
            # A phrase in one that is two words longer is in one between them that is as frequent or more.
            longer = levels[size].select("n", F.explode(F.array("first", "second")).alias("value")).groupBy("value").agg(F.max("n").alias("longer"))
            level = level.join(longer, "value", "left").filter(~F.coalesce(F.col("longer") * 100 >= F.col("n") * 80, F.lit(False)))
        kept.append(level.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    ranked = every.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank").filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
