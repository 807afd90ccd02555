"""MinHash near-deduplication (operator 10): universal hash minima, banding, verified links, connected components.

1. Each text's set of word shingles is hashed; rows with equal sets fall into one node.
2. ``BANDS`` bands of ``ROWS`` minima make a node's bucket keys. Two sets of similarity 0.8 miss each other in all
   bands with probability (1 - 0.8^6)^45 = 1e-6. Keys that occur once are dropped through a bitmap of the others.
3. In each bucket, all nodes are linked to two pivots, its least and greatest node. Pairs whose sizes or
   128-bit sketches exclude the threshold are dropped; the others are verified on their full sets.
4. Components by large-star and small-star. Buckets that still hold several components are joined with
   themselves, across components only, so that no link of a bucket is lost where neither end is a pivot. Besides sizes and
   sketches, a bound drops pairs there: each set is hashed to 2,048 bits, and items whose bits the other set lacks
   are not in it. What remains is verified and joins components.

So pairs are few where a group is large, since a large group of near copies is one component after step 3.

Defined cases: a text without words (or null) has no shingles and is linked with nothing; with fewer words than a
shingle, all words are one; rows with equal sets are linked; rows repeated in full share doc_id and component, and are
kept alike; a null doc_id comes last: its row's component is named by the known ids, and where there are none, the id is null and the row is kept;
an empty table gives an empty table;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint, filter_of, probe, stage
from ._shingles import hashes_of, mix
from .components import components

#: Words of a shingle, unless a caller says otherwise.
WIDTH = 5
BANDS, ROWS = 45, 6
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Differing bits of 128 up to which a pair is verified. At similarity 0.8, 12.8 differ on average, and 33 or more
#: with probability 1e-7.
SKETCH_BITS = 32
FILTER_BITS = 1 << 26
SALTS = 64
#: Words of 64 bits that a set is hashed to for the bound on what two sets share.
WORDS = 32
NULL_ID = -(2**63)

_RNG = np.random.default_rng(7)
_A = (_RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_MIX = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over a set of 64-bit shingles."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (_A * x[None, k : k + 4096] + _B).min(1), out=out)
    return out


def _signature(shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
    low = minima(shingles)
    keys = mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) + _BAND)
    bits = (low[:128] * np.uint32(2654435769)) >> np.uint32(31)
    words = np.packbits(bits.astype(np.uint8)).view(np.int64)
    return keys.view(np.int64), int(words[0]), int(words[1])


def _sets(width: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part["text"]:
                own = np.unique(hashes_of(text, width))
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                rows.append((len(own), digest, *(_signature(own) if len(own) else (np.zeros(0, np.int64), 0, 0))))
            out = pd.DataFrame(rows, columns=["n", "digest", "keys", "s1", "s2"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy(dtype=object))
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return run


def _fetch(width: int):
    """Sets of the texts of candidate rows (doc_id, text, node, digest); a doc_id's other texts drop out by their digest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for node, digest, text in zip(part["node"], part["digest"], part["text"], strict=True):
                own = np.unique(hashes_of(text, width))
                if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == bytes(digest):
                    rows.append((node, own.view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "items"])

    return run


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes whose sizes and sketches allow the threshold."""
    for x in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("s1").alias(f"a{x}"), F.col("s2").alias(f"b{x}")), x)
    return pairs.filter(_allowed("nu", "nv", "au", "av", "bu", "bv", percent)).select("u", "v")


def _allowed(n1: str, n2: str, a1: str, a2: str, b1: str, b2: str, percent: int):
    sizes = 100 * F.least(F.col(n1), F.col(n2)) >= percent * F.greatest(F.col(n1), F.col(n2))
    bits = F.bit_count(F.col(a1).bitwiseXOR(F.col(a2))) + F.bit_count(F.col(b1).bitwiseXOR(F.col(b2)))
    return sizes & (bits <= SKETCH_BITS)


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, items) with the full sets of the wanted nodes (column node). Only their texts are shuffled."""
    found = stage(nodes.join(wanted, "node").select("node", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "digest"), "wanted")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), "text")
    near = probe(keyed, "key", filter_of(found, "key", FILTER_BITS)).filter("__maybe").select("key", "text")
    sets = near.join(found, "key").select("node", "digest", "text").mapInPandas(_fetch(width), "node long, items array<long>")
    return stage(sets.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("iu")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("items").alias("iv")), "v")
    both = both.withColumn("shared", F.size(F.array_intersect("iu", "iv")))
    return both.filter(100 * F.col("shared") >= percent * (F.size("iu") + F.size("iv") - F.col("shared"))).select("u", "v")


def _bitsets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets hashed to ``64 * WORDS`` bits each, and how many of the bits are set."""
    for part in parts:
        bits = np.zeros((len(part), 64 * WORDS), np.uint8)
        for k, items in enumerate(part["items"]):
            bits[k, (items.view(np.uint64) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pd.DataFrame({"node": part["node"], "p": bits.sum(1, dtype=np.int64), **{f"w{k}": words[:, k] for k in range(WORDS)}})


def _can_share(percent: int):
    """Whether two sets can reach the threshold: an item whose bit the other set does not have is not in it."""
    common = reduce(add, [F.bit_count(F.col(f"w{k}_u").bitwiseAND(F.col(f"w{k}_v"))) for k in range(WORDS)])
    most = F.least(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v")) + common
    return 100 * most >= percent * (F.col("n_u") + F.col("n_v") - most)


def _across(members: DataFrame, named: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that met in a bucket without a pivot at either end."""
    open_ = members.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = checkpoint(open_.join(checkpoint(mixed), "key").join(nodes.select("node", "n", "s1", "s2"), "node"))
    if open_.isEmpty():
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    sides = [open_.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "s1", "s2")]) for x in "uv"]
    likely = (F.col("component_u") != F.col("component_v")) & _allowed("n_u", "n_v", "s1_u", "s1_v", "s2_u", "s2_v", percent)
    # Nodes with a likely partner, each once; the partners themselves are not listed yet.
    left, right = sides[0].alias("left"), sides[1].alias("right")
    some = left.join(right, (F.col("left.key") == F.col("right.key")) & likely, "left_semi").select(F.col("node_u").alias("node")).distinct()
    sets = _sets_of(some, nodes, docs, width)
    names = ["node", "p", *[f"w{k}" for k in range(WORDS)]]
    known = checkpoint(sets.mapInPandas(_bitsets, T.StructType([T.StructField(c, T.LongType(), False) for c in names])))
    sides = [x.join(known.select([F.col(c).alias(f"{c}_{y}") for c in names]), f"node_{y}") for x, y in zip(sides, "uv", strict=True)]
    left, right = sides[0].alias("left"), sides[1].alias("right")
    met = left.join(right, (F.col("left.key") == F.col("right.key")) & (F.col("node_u") < F.col("node_v")) & likely & _can_share(percent))
    return _confirmed(checkpoint(met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()), sets, percent)


def _joined(named: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) of named with further links (u, v): their ends' components are joined, not all nodes anew."""
    more = checkpoint(more)
    if more.isEmpty():
        return named
    ends = more.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    every = checkpoint(named.unionByName(ends.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))))
    for x in "uv":
        more = more.join(every.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x)
    above = components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("above"))
    return checkpoint(every.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")))


def near_groups(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_sets(width), "doc_id long, n long, digest binary, keys array<long>, s1 long, s2 long")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "signatures")
    salted = rows.filter("n > 0").select("doc_id", "n", "digest", "row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    partial = salted.groupBy("digest", "salt").agg(F.min(place).alias("first"), F.first("n").alias("n"))
    owner = partial.groupBy("digest").agg(F.min("first").alias("first")).select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("node"))
    owner = checkpoint(owner)
    nodes = stage(owner.join(rows.select(F.col("row").alias("node"), "n", "keys", "s1", "s2"), "node"), "nodes")

    buckets = nodes.select("node", F.explode("keys").alias("key"))
    several = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    several = stage(several, "buckets")
    members = probe(buckets, "key", filter_of(several, "key", FILTER_BITS)).filter("__maybe").select("node", "key")
    members = stage(members.join(several, "key"), "members")

    star = members.select("node", F.explode(F.array("low", "high")).alias("pivot")).filter("node <> pivot")
    star = star.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    pairs = checkpoint(_likely(star, nodes, percent))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = checkpoint(_confirmed(pairs, _sets_of(ends, nodes, docs, width), percent))
    named = components(links)
    final = _joined(named, _across(members, named, nodes, docs, width, percent))

    owned = owner.join(final, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    names = owned.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("least"))
    owned = checkpoint(owned.join(checkpoint(names), "component").select("digest", F.col("least.doc_id").alias("component_id")))
    back = partial.select("digest", "salt").join(owned, "digest")
    linked = salted.join(back, ["digest", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns kept, with one document of each group: the one with the smallest doc_id.

    Rows that a filter of the dropped ids is certain not to hold pass straight through, so few texts are shuffled.
    """
    dropped = checkpoint(near_groups(docs, width=width, percent=percent).filter("not kept").select("doc_id").distinct())
    names = docs.columns
    packed = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    probed = probe(packed, "key", filter_of(dropped.withColumnRenamed("doc_id", "key"), "key", FILTER_BITS))
    rest = probed.filter("__maybe").join(dropped.withColumnRenamed("doc_id", "key"), "key", "left_anti").select("doc")
    return probed.filter("not __maybe").select("doc").unionByName(rest).select([F.col(f"doc.`{c}`").alias(c) for c in names])
