"""Conversation structure repair (operator 11) by prefix-doubling path ranking.

A conversation's rows are letters of an automaton with four states (nothing yet, after a system turn, after a user turn, after an assistant
turn), and its cheapest edits are a path through nodes (place between rows, state). Arcs are Keep, Rerole, Delete and Insert.

1. Damaged rows are counted per (conversation, turn, digest of role and text) and range-sorted, so that a conversation may span tasks. One
   byte a row, its role's initial and fault, is all that the path needs: bytes are cut into blocks of ``BLOCK`` rows at most.
2. Cost DP: backward over the places of a block, for many blocks at once. Where a conversation has several blocks, each gives a matrix of costs
   from state to state, and doubled min-plus products over blocks give the costs behind each block.
3. Ranking: the arcs that reach the least cost are kept. Nodes are ranked by the least audit of 1, 2, 4, ... edits that begins at them: the rank for
   twice the length comes from a node's own rank and that of the node that its pointer reaches, and pointers double with it. A node's arc is the
   one of least letter, then least rank of its target; paths are read by doubled pointers, from every state that a block may be entered in.
4. Doubled products of the maps from entry to exit state give the state in which each block is entered, hence its audit.
5. Rows and audits, sorted, stream through one hash per conversation, a batch at a time.

Defined cases: a null role or text is one space, a null conv_id or turn is one space in the damage key; null turns come first; rows of one turn go
by digest of role and text, so that equal rows are neighbours (the copy of damage 3 too); rows repeated in full are damaged alike;
a role that begins with none of ``s u a`` (or is empty) can only be deleted or reroled; a conversation without rows has zeros and an empty audit; an
empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import checkpoint, stage, with_group

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows of a block at most, and nodes of paths that a task works on together.
BLOCK, NODES = 4_096, 1 << 21
SALTS = 64
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = "\0DIKR"
#: State after a row that is kept, by state and initial (s, u, a, other), or -1; state after an inserted or reroled one.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_GIVEN = np.array([2, 2, 3, 2])
_FAR = 1 << 60
#: Costs at the end of a conversation, before anything is inserted there.
_FINAL = np.array([0, _FAR, _FAR, 0])
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """who (conversation as text), conv_id, turn, role, text, digest: the rows after damage by the checksum of ``conv_id:turn``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select(_who(), "conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _who() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("who")


def _placed() -> list[Column]:
    """Order of a turn without nulls: those come first."""
    return [F.col("turn").isNotNull().cast("int").alias("dated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at")]


def _coded(rows: DataFrame) -> DataFrame:
    """who, turn, digest, n, blank, again (seen in an earlier turn), code of the first such row and of its copies."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    start = F.substring("role", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    blank, cut = bare == "", ~F.substring(bare, -1, 1).isin(*ENDS)
    counted = rows.groupBy("who", "turn", "digest", initial.alias("initial"), blank.alias("blank"), cut.alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    group = counted.withColumn("group", F.sha2(F.concat(F.col("who").cast("binary"), "digest"), 256))
    met = with_group(group, "group", F.xxhash64("turn"), SALTS, [F.min(F.struct("turn")).alias("least")], [F.min("least").alias("least")])
    again = ~F.col("turn").eqNullSafe(F.col("least.turn"))
    met = met.select("who", "turn", "digest", "n", "initial", "blank", (again & ~F.col("blank")).alias("again"), "cut")
    must = F.col("blank") | F.col("again")
    code = F.col("initial") + F.when(must, 4).when(F.col("cut"), 8).otherwise(0)
    return met.select("who", "turn", *_placed(), "digest", "n", "blank", "again", "cut", code.alias("code"), (F.col("initial") + 4).alias("copy"))


def _faults(coded: DataFrame) -> DataFrame:
    """who, gaps, blank, duplicate, truncated."""
    bad = F.col("blank") | F.col("again")
    twice = F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)
    turns = coded.groupBy("who", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(twice).alias("duplicate"), F.sum(F.when(~bad & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("who").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


_BLOCKS = "who string, dated int, at long, digest binary, chunk long, seq long, codes binary, illegal long, head int, tail int"


def _illegal(initials: np.ndarray) -> int:
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 1) & (b == 2)) | (((a == 0) | (a == 2)) & (b == 1)))).sum())


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted coded rows to blocks of their codes, each with the key of its first row."""
    names = ["who", "dated", "at", "digest", "chunk", "seq", "codes", "illegal", "head", "tail"]
    who, key, held, size, seq = None, None, [], 0, 0

    def block():
        codes = np.concatenate(held)
        return (who, *key, seq, codes.tobytes(), _illegal(codes & 3), int(codes[0] & 3), int(codes[-1] & 3))

    for part in parts:
        out = []
        for next_who, dated, at, digest, chunk, n, code, copy in zip(*(part[c] for c in ("who", "dated", "at", "digest", "chunk", "n", "code", "copy")), strict=True):
            if next_who != who:
                if size:
                    out.append(block())
                who, held, size, seq = next_who, [], 0, 0
            codes = np.full(n, copy, np.uint8)
            codes[0] = copy if chunk else code
            while codes.size:
                if not size:
                    key = (dated, at, digest, chunk)
                take, codes = codes[: BLOCK - size], codes[BLOCK - size :]
                held.append(take)
                size += take.size
                if size == BLOCK:
                    out.append(block())
                    held, size, seq = [], 0, seq + 1
        yield pd.DataFrame(out, columns=names)
    if size:
        yield pd.DataFrame([block()], columns=names)


def costs_to_go(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from each node to the end, (places, 4), and the first place of each block; blocks by falling length.

    ``ends`` are the costs at a block's last place; only at the last place of a conversation can rows be inserted.
    """
    sizes = np.array([c.size for c in codes])
    base = np.append(0, np.cumsum(sizes + 1))[:-1]
    cost = np.full((int((sizes + 1).sum()), 4), _FAR)
    rows = np.concatenate([np.append(c, 0) for c in codes]).astype(np.int64)
    kept = np.where(_KEPT < 0, 4, _KEPT)

    def inserted(e: np.ndarray) -> np.ndarray:
        once = np.minimum(e, INSERT + e[:, _GIVEN])
        return np.minimum(once, INSERT + once[:, _GIVEN])

    for t in range(int(sizes[0]), -1, -1):
        inner, every = int(np.searchsorted(-sizes, -t, "left")), int(np.searchsorted(-sizes, -t, "right"))
        if every > inner:  # blocks that end here
            here = ends[inner:every]
            cost[base[inner:every] + t] = np.where(last[inner:every, None], inserted(here), here)
        if inner:
            code, after = rows[base[:inner] + t], cost[base[:inner] + t + 1]
            stay = np.where(code >> 2 & 1, _FAR, TRUNCATED * (code >> 3 & 1))[:, None]
            keep = np.take_along_axis(np.column_stack([after, np.full(inner, _FAR)]), kept[:, code & 3].T, axis=1) + stay
            e = np.minimum(np.minimum(keep, after[:, _GIVEN] + stay + REROLE), after + DELETE)
            cost[base[:inner] + t] = np.minimum(inserted(e), _FAR)
    return cost, base


def least_audits(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray, entries: int) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """Costs (blocks, 4), audits and exit states from the first ``entries`` states of each block; blocks by falling length."""
    cost, base = costs_to_go(codes, ends, last)
    sizes = np.array([c.size for c in codes])
    places = cost.shape[0]
    code = np.concatenate([np.append(c, 0) for c in codes]).astype(np.int64)
    inner = np.ones(places, bool)
    inner[base + sizes] = False
    may_insert = inner.copy()
    may_insert[base + sizes] = last
    after = np.vstack([cost[1:], np.full((1, 4), _FAR)])
    stay = np.where(code >> 2 & 1, _FAR, TRUNCATED * (code >> 3 & 1))[:, None]
    state, place = np.arange(4)[None, :], np.arange(places)[:, None]
    onto = _KEPT[:, code & 3].T
    known = cost < _FAR
    options = (
        (DELETE + after, inner[:, None], 4 * (place + 1) + state),
        (INSERT + cost[:, _GIVEN], may_insert[:, None], 4 * place + _GIVEN[None, :]),
        (stay + np.take_along_axis(after, np.maximum(onto, 0), axis=1), inner[:, None] & (onto >= 0), 4 * (place + 1) + onto),
        (REROLE + stay + after[:, _GIVEN], inner[:, None], 4 * (place + 1) + _GIVEN[None, :]),
    )
    source, letter, target = [], [], []
    for k, (through, allowed, to) in enumerate(options, 1):
        found = np.flatnonzero((known & allowed & (through == cost)).ravel())
        source.append(found)
        letter.append(np.full(found.size, k))
        target.append(to.ravel()[found])
    source, letter, target = (np.concatenate(x) for x in (source, letter, target))

    # Rank 0 is the end of the audit. Letters of a node's arcs differ, so the least letter names one pointer.
    rank, pointer = np.zeros(4 * places, np.int64), np.arange(4 * places)
    order = np.lexsort((letter, source))
    first = order[np.append(True, source[order][1:] != source[order][:-1])[: order.size]]
    rank[source[first]], pointer[source[first]] = letter[first], target[first]
    ended = rank == 0
    while True:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
        if ended[pointer].all():
            break
        pointer = pointer[pointer]
    order = np.lexsort((rank[target], letter, source))
    first = order[np.append(True, source[order][1:] != source[order][:-1])[: order.size]]
    mark, step = np.zeros(4 * places, np.uint8), np.arange(4 * places)
    mark[source[first]], step[source[first]] = letter[first], target[first]

    path = (4 * base[:, None] + np.arange(entries)[None, :]).reshape(-1, 1)
    while not ended[path[:, -1]].all():
        path = np.hstack([path, step[path]])
        step = step[step]
    raw = np.frombuffer(LETTERS.encode(), np.uint8)[mark[path]]
    audits = [bytes(r).rstrip(b"\0").decode() for r in raw]
    return cost[base], [audits[k : k + entries] for k in range(0, len(audits), entries)], (step[path[:, 0]] % 4).reshape(-1, entries)


def _grouped(sizes: np.ndarray, entries: int) -> Iterator[np.ndarray]:
    """Places of blocks by falling length, in groups whose paths have ``NODES`` nodes at most, or of one block."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < order.size:
        take = max(1, NODES // (entries * 4 * (int(sizes[order[at]]) + 2)))
        yield order[at : at + take]
        at += take


def _matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs from state to state through each block."""
    for part in parts:
        codes = [np.frombuffer(c, np.uint8) for c in part["codes"]]
        found = [None] * len(codes)
        for group in _grouped(np.array([c.size for c in codes]), 4):
            some, out = [codes[k] for k in group], []
            for state in range(4):
                ends = np.full((group.size, 4), _FAR)
                ends[:, state] = 0
                cost, base = costs_to_go(some, ends, np.zeros(group.size, bool))
                out.append(cost[base])
            for k, m in zip(group, np.stack(out, axis=2).reshape(-1, 16), strict=True):
                found[k] = m
        yield pd.DataFrame({"who": part["who"], "b": part["b"], "through": found})


def _solved(entries: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            codes = [np.frombuffer(c, np.uint8) for c in part["codes"]]
            last = part["behind"].isna().to_numpy()
            ends = np.array([_FINAL if x else y for x, y in zip(last, part["behind"], strict=True)]).reshape(-1, 4)
            cost, audits, exits = [None] * len(codes), [None] * len(codes), [None] * len(codes)
            for group in _grouped(np.array([c.size for c in codes]), entries):
                found = least_audits([codes[k] for k in group], ends[group], last[group], entries)
                for k, c, a, e in zip(group, *found, strict=True):
                    cost[k], audits[k], exits[k] = int(c[0]), a, e
            yield pd.DataFrame({"who": part["who"], "b": part["b"], "cost": cost, "audits": audits, "exits": exits})

    return run


def _times(a: Column, b: Column) -> Column:
    """The min-plus product of two matrices of 4 x 4 in rows."""
    cell = lambda i, j: F.array_min(F.array(*[a[4 * i + k] + b[4 * k + j] for k in range(4)]))
    return F.array(*[F.least(cell(i, j), F.lit(_FAR)) for i in range(4) for j in range(4)])


def _doubled(rows: DataFrame, column: str, joined, blocks: int, ahead: bool) -> DataFrame:
    """Products of ``column`` over all blocks from b on (ahead) or up to b, by joins with blocks 1, 2, 4 ... away."""
    step = 1
    while step < blocks:
        other = rows.select("who", (F.col("b") + (-step if ahead else step)).alias("b"), F.col(column).alias("other"))
        more = joined(F.col(column), F.col("other")) if ahead else joined(F.col("other"), F.col(column))
        met = rows.join(other, ["who", "b"], "left").withColumn(column, F.when(F.col("other").isNull(), F.col(column)).otherwise(more)).drop("other")
        rows = checkpoint(met)
        step *= 2
    return rows


def _audits(blocks: DataFrame) -> DataFrame:
    """who, b, dated, at, digest, audit, cost (of the whole conversation, in its first block) of blocks (who, b, blocks, codes ...)."""
    kinds = "who string, b long, cost long, audits array<string>, exits array<long>"
    keys = blocks.select("who", "b", "dated", "at", "digest")
    one = blocks.filter("blocks = 1").select("who", "b", "codes", F.lit(None).cast("array<long>").alias("behind"))
    done = one.mapInPandas(_solved(1), kinds).select("who", "b", "cost", F.col("audits")[0].alias("audit"))
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    if most > 1:
        several = blocks.filter("blocks > 1").select("who", "b", "blocks", "codes")
        through = checkpoint(several.filter("b > 0").mapInPandas(_matrices, "who string, b long, through array<long>"))
        through = _doubled(through, "through", _times, most, True)
        final = [0, 2 * INSERT, INSERT, 0]
        start = F.array(*[F.array_min(F.array(*[F.col("through")[4 * i + j] + final[j] for j in range(4)])) for i in range(4)])
        behind = through.select("who", (F.col("b") - 1).alias("b"), start.alias("behind"))
        solved = stage(several.join(behind, ["who", "b"], "left").select("who", "b", "codes", "behind").mapInPandas(_solved(4), kinds), "solved")
        exits = _doubled(checkpoint(solved.select("who", "b", "exits")), "exits", lambda a, b: F.transform(a, lambda s: b[s.cast("int")]), most, False)
        entry = exits.select("who", (F.col("b") + 1).alias("b"), F.col("exits")[0].alias("entry"))
        met = solved.join(entry, ["who", "b"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)).cast("int"))
        done = done.unionByName(met.select("who", "b", "cost", F.col("audits")[F.col("entry")].alias("audit")))
    return done.join(keys, ["who", "b"])


def _repaired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows and audits (kind 0, before the rows of their first key) to who, audit, repaired_sha256."""
    who, told, at, letters, state, digest, some = None, [], 0, "", 0, None, False

    def put(role: str, text: str) -> None:
        nonlocal some
        digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        some = True

    def given(text: str) -> None:
        nonlocal state
        put("assistant" if state == 2 else "user", text)
        state = int(_GIVEN[state])

    def take() -> str | None:
        """The next letter; inserted rows are put on the way."""
        nonlocal at, letters
        while True:
            if at == len(letters):
                if not waiting:
                    return None
                letters, at = waiting.pop(0), 0
                continue
            at += 1
            if letters[at - 1] != "I":
                return letters[at - 1]
            given("")

    waiting: list[str] = []
    for part in parts:
        out = []
        for next_who, kind, role, text, audit in zip(part["who"], part["kind"], part["role"], part["text"], part["audit"], strict=True):
            if next_who != who:
                if who is not None:
                    take()
                    out.append((who, "".join(told), digest.hexdigest()))
                who, told, waiting, at, letters, state, digest, some = next_who, [], [], 0, "", 0, hashlib.sha256(), False
            if kind == 0:
                told.append(audit)
                waiting.append(audit)
                continue
            letter = take()
            if letter == "K":
                put(role, text)
                state = int(_KEPT[state, "sua".index(role[0])])
            elif letter == "R":
                given(text)
        yield pd.DataFrame(out, columns=["who", "audit", "repaired_sha256"])
    if who is not None:
        take()
        yield pd.DataFrame([(who, "".join(told), digest.hexdigest())], columns=["who", "audit", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation (conv_id, turn, role, text)."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    coded = stage(_coded(rows), "coded")
    chunks = coded.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK)))).withColumn("n", F.least(F.col("n") - F.col("chunk") * BLOCK, F.lit(BLOCK)))
    key = ["who", "dated", "at", "digest", "chunk"]
    ordered = chunks.select(*key, "n", "code", "copy").repartitionByRange(*key).sortWithinPartitions(*key)
    cut = stage(ordered.mapInPandas(_cut, _BLOCKS), "blocks")
    by = W.partitionBy("who").orderBy("dated", "at", "digest", "chunk", "seq")
    numbered = cut.withColumn("b", F.row_number().over(by).cast("long") - 1).withColumn("before", F.lag("tail").over(by)).withColumn("blocks", F.count(F.lit(1)).over(W.partitionBy("who")))
    blocks = stage(numbered, "numbered")
    fits = ((F.col("before") == 1) & (F.col("head") == 2)) | (F.col("before").isin(0, 2) & (F.col("head") == 1))
    illegal = blocks.groupBy("who").agg(F.sum(F.col("illegal") + F.when(F.col("before").isNull() | fits, 0).otherwise(1)).alias("illegal"))
    audits = stage(_audits(blocks), "audits")

    none = F.lit(None).cast("string")
    told = audits.select("who", "dated", "at", "digest", F.lit(0).alias("kind"), "b", none.alias("role"), none.alias("text"), "audit")
    every = told.unionByName(rows.select("who", *_placed(), "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("b"), "role", "text", none.alias("audit")))
    streamed = every.repartition("who").sortWithinPartitions("who", "dated", "at", "digest", "kind", "b").select("who", "kind", "role", "text", "audit")
    shas = stage(streamed.mapInPandas(_repaired, "who string, audit string, repaired_sha256 string"), "shas")

    ids = conversations.select("conv_id").distinct().select("conv_id", _who())
    cost = audits.filter("b = 0").select("who", "cost")
    out = ids.join(_faults(coded), "who", "left").join(illegal, "who", "left").join(cost, "who", "left").join(shas, "who", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"))
