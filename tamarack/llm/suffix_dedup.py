"""Suffix-array deduplication (operator 7) by bucket-pointer refinement: bytes of repeated 100-byte strings are removed.

Only suffixes that can share 100 bytes are sorted, and texts never cross the shuffle whole unless they hold some.

1. Equal texts fall into the one of smallest doc_id; copies are decided at once.
2. Initial buckets: each window of 100 bytes names its least-hashed 32-gram, its anchor, so that equal windows fall into
   the same 32-gram bucket at the same distance. Buckets of one are dropped through a filter of fixed size.
3. In bucket order, runs of windows with an anchor whose whole stretches of text are equal form a class: its first
   member stays, all others' windows are repeats. Buckets with one class are finished. The order is a range sort by bucket, class and place, so a
   bucket may span tasks; what the ends of tasks leave open is settled on two rows a task.
4. Buckets with several classes are refined (``sort_suffixes``): all suffixes of a task's buckets start in buckets of their first 16 bytes, with the
   place of the bucket in the order as pointer. Bucket by bucket, some thousand suffixes at a time, suffixes are sorted on the pointers of the suffixes
   16 bytes further on, get new pointers, and are sorted again on those 32, 48 ... bytes further on while they share a bucket. New pointers hold at once, for
   deeper rounds and for all buckets behind, which so are split the further. Windows that share 100 bytes then are neighbours; all but the first are repeats.
   A bucket of more than ``PIECE`` stretches is dealt out over tasks by the identifiers of its windows' later offsets (all of them, as one hash); windows of
   equal bytes are met in each task before that, so the number of tasks bounds how many of them meet.
5. Covered bytes are joined to runs and cut out of the texts.

Defined cases: a null or empty text has 0 bytes and nothing removed; texts under 100 bytes are never cut; of rows repeated
in full one is the original; rows that share a doc_id but not the text are ordered by a hash of the text; a null doc_id
comes first; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import BLOCK, LENGTH, LONGEST, Sums, anchors
from ._common import Filter, filter_bytes, filter_of, probe, stage, with_group
from ._shingles import mix
from .exact_dedup import repeated_slots

FILTER_BITS = 1 << 26
#: Bits of the filter of repeated anchors, 32 MB; its hashes are of about one in 35 bytes.
ANCHOR_BITS = 1 << 28
#: Stretches of a bucket that one task refines at most; larger buckets are dealt out by the bytes of their windows.
PIECE = 20_000
#: Bytes of the first buckets, suffixes that are refined together, and windows that a task holds to meet equal ones.
GRAM, CHUNK, HELD = 16, 1 << 16, 100_000
#: Stretches whose suffixes are sorted in one array.
SORTED = 4_000
NULL_ID = -(2**63)
SALTS = 64


def _numbered(docs: DataFrame, shared_ids: Filter | None) -> DataFrame:
    """doc_id (never null), text, digest, tie: 0, or a hash of the text where the doc_id may occur more than once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    out = out.withColumn("digest", F.unhex(F.sha2("text", 256)))
    if shared_ids is None:
        return out
    return probe(out, "doc_id", shared_ids).withColumn("tie", F.when(F.col("__maybe"), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))).drop("__maybe")


def _segments(doc_ids, ties, texts) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """Blocks of texts laid end to end: (doc_id, tie, offset in the text) of each, the bytes, the bounds. Longer texts are cut, with an overlap."""
    owners, parts, bounds = [], [], [0]
    for doc_id, tie, text in zip(doc_ids, ties, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - LENGTH + 1), LONGEST):
            piece = raw[at : at + LONGEST + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            owners.append((doc_id, tie, at))
            parts.append(piece)
            bounds.append(bounds[-1] + len(piece))
            if bounds[-1] >= BLOCK:
                yield owners, np.frombuffer(b"".join(parts), np.uint8), np.array(bounds)
                owners, parts, bounds = [], [], [0]
    if parts:
        yield owners, np.frombuffer(b"".join(parts), np.uint8), np.array(bounds)


def _hash_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for _, raw, bounds in _segments(part["doc_id"], part["doc_id"], part["text"]):
            hashes = anchors(raw, bounds, Sums(raw, 0))[3]
            yield pd.DataFrame({"anchor": hashes.view(np.int64)})


def _stretches(bitmap, bits: int):
    """Stretches of windows whose anchor may be repeated: anchor, whole (hash of all bytes), doc_id, tie, first, last."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked = np.frombuffer(bitmap.value, np.uint8)
        for part in parts:
            for owners, raw, bounds in _segments(part["doc_id"], part["tie"], part["text"]):
                text, first, last, hashes, anchor = anchors(raw, bounds, Sums(raw, 0))
                slot = hashes & np.uint64(bits - 1)
                keep = (marked[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                text, first, last, hashes, anchor = (x[keep] for x in (text, first, last, hashes, anchor))
                if not text.size:
                    continue
                whole = Sums(raw, 1).of(first, last + LENGTH) ^ mix((last - first).astype(np.uint64) * np.uint64(1000003) + (anchor - first).astype(np.uint64))
                known = np.array(owners, np.int64)[text]
                start = first - bounds[text] + known[:, 2]
                yield pd.DataFrame({"anchor": hashes.view(np.int64), "whole": whole.view(np.int64), "doc_id": known[:, 0], "tie": known[:, 1], "first": start, "last": start + last - first})

    return run


def _classes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of stretches sorted by anchor, whole and place: those that repeat an earlier one (AGAIN), and the classes' first ones in buckets
    with several classes (OPEN). The first and the last class of a task may go on in others: their first ones are EDGEs, ``several`` where their bucket
    is known to have more classes. Needs one row of memory."""
    before, waiting, linked, edge = None, None, False, True
    for part in parts:
        if not len(part):
            continue
        anchor, whole = part["anchor"].to_numpy(), part["whole"].to_numpy()
        new = np.ones(len(part), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        new[0] = before != (anchor[0], whole[0])
        before = (anchor[-1], whole[-1])
        yield part.loc[~new, _STRETCH].assign(state=AGAIN, several=False)
        firsts = part.loc[new, _STRETCH]
        if waiting is not None:
            firsts = pd.concat([waiting, firsts], ignore_index=True)
        if not len(firsts):
            continue
        own = firsts["anchor"].to_numpy()
        same = own[1:] == own[:-1]
        opened = np.append(linked, same) if waiting is not None else np.append(False, same)
        opened[:-1] |= same
        done = firsts.iloc[:-1].assign(state=OPEN, several=opened[:-1])
        if edge and len(done):
            yield done.iloc[:1].assign(state=EDGE)
            done, edge = done.iloc[1:], False
        yield done[done["several"]]
        waiting, linked = firsts.iloc[-1:], bool(opened[-1])
    if waiting is not None:
        yield waiting.assign(state=EDGE, several=linked)


_STRETCH = ["anchor", "whole", "doc_id", "tie", "first", "last"]
AGAIN, OPEN, EDGE = 0, 1, 2


def _settled(found: DataFrame) -> DataFrame:
    """What _classes gives, with its edges settled, two a task at most: anchor, doc_id, tie, first, last, open."""
    names = ["anchor", "doc_id", "tie", "first", "last"]
    edges = found.filter(F.col("state") == EDGE)
    place = F.struct("doc_id", "tie", "first")
    least = edges.groupBy("anchor", "whole").agg(F.min(place).alias("least"), F.max("several").alias("several"))
    opened = least.groupBy("anchor").agg((F.max("several") | (F.count(F.lit(1)) > 1)).alias("open"))
    met = edges.join(least.drop("several"), ["anchor", "whole"]).join(opened, "anchor").withColumn("again", place != F.col("least"))
    ends = met.filter(F.col("again") | F.col("open")).select(*names, (~F.col("again")).alias("open"))
    return found.filter(F.col("state") != EDGE).select(*names, (F.col("state") == OPEN).alias("open")).unionByName(ends)


_PIECES = "anchor long, part long, doc_id long, tie long, first long, end long, data binary"


def _bytes_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of open stretches; of large buckets, those of each window, with a hash of them as part.

    Of equal windows in a task the least goes on, and the others are repeats already: a row without data, its end instead.
    """
    names = ["anchor", "part", "doc_id", "tie", "first", "end", "data"]
    held: dict[tuple[int, bytes], tuple[int, int, int]] = {}

    def given() -> pd.DataFrame:
        keys = (int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True) for _, data in held)
        rows = [(anchor, key, *place, -1, data) for key, ((anchor, data), place) in zip(keys, held.items(), strict=True)]
        held.clear()
        return pd.DataFrame(rows, columns=names)

    for part in parts:
        rows = []
        for doc_id, tie, text, wanted in zip(part["doc_id"], part["tie"], part["text"], part["wanted"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                first, last, anchor = w["first"], w["last"], w["anchor"]
                if not w["large"]:
                    rows.append((anchor, 0, doc_id, tie, first, -1, raw[first : last + LENGTH]))
                    continue
                for start in range(first, last + 1):
                    key, place = (anchor, raw[start : start + LENGTH]), (doc_id, tie, start)
                    other = held.setdefault(key, place)
                    if other != place:
                        held[key] = min(place, other)
                        late = max(place, other)
                        rows.append((anchor, hash(late), *late, late[2] + LENGTH, None))
        yield pd.DataFrame(rows, columns=names)
        if len(held) >= HELD:
            yield given()
    yield given()


def _grams(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as numbers that sort like them; raw needs seven more bytes at its end."""
    out = np.zeros(raw.size - 7, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | raw[k : raw.size - 7 + k]
    return out


def sort_suffixes(raw: np.ndarray, wanted: np.ndarray | None = None, depth: int = LENGTH) -> np.ndarray:
    """Pointers of all suffixes of raw: smaller for suffixes that sort first, equal only for those that share ``depth`` bytes (zeros follow raw).

    With ``wanted``, places as booleans, that holds for these: buckets with fewer than two of them are left as they are, all members with one pointer.
    """
    padded = np.append(raw, np.zeros(depth + 2 * GRAM, np.uint8))
    low = _grams(padded)
    n = low.size - 8
    order = np.lexsort((low[8:], low[:n]))
    left, right = low[:n][order], low[8:][order]
    new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    pointer = np.zeros(n, np.int64)
    pointer[order] = np.repeat(heads, sizes)
    # Places behind the last gram hold zeros alone, as do the last ones before.
    limit = n - 1
    asked = np.ones(n, bool) if wanted is None else np.append(wanted, np.zeros(n - wanted.size, bool))
    several = np.flatnonzero((sizes > 1) & (np.add.reduceat(asked[order].astype(np.int64), heads) > 1))
    bounds = np.append(0, np.cumsum(sizes[several]))
    at = 0
    while at < several.size:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        group = several[at:stop]
        begin = np.repeat(heads[group] - (bounds[at:stop] - bounds[at]), sizes[group])
        members = order[begin + np.arange(begin.size)]
        offset = GRAM
        while offset < depth and members.size:
            own, later = pointer[members], pointer[np.minimum(members + offset, limit)]
            sort = np.lexsort((later, own))
            members, own, later = members[sort], own[sort], later[sort]
            bucket = np.append(True, own[1:] != own[:-1])
            split = bucket | np.append(True, later[1:] != later[:-1])
            place = np.arange(members.size)
            first = np.maximum.accumulate(np.where(split, place, 0))
            # A bucket's suffixes have as many places in the order, so its parts have room behind its pointer.
            pointer[members] = own + first - np.maximum.accumulate(np.where(bucket, place, 0))
            parts = np.flatnonzero(split)
            open_ = np.add.reduceat(asked[members].astype(np.int64), parts) > 1
            members = members[np.repeat(open_, np.diff(np.append(parts, members.size)))]
            offset += GRAM
        at = stop
    return pointer


def window_classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each window that starts at ``starts``: equal for equal 100 bytes, and for no others."""
    wanted = np.zeros(raw.size, bool)
    wanted[starts] = True
    pointer = sort_suffixes(raw, wanted)[starts]
    order = np.argsort(pointer, kind="stable")
    low = _grams(np.append(raw, np.zeros(8, np.uint8)))
    new = np.append(True, np.diff(pointer[order]) != 0)
    # Neighbours with other pointers may differ behind their 100 bytes only: eight bytes at a time, those that differ earlier drop out.
    near = np.flatnonzero(new[1:])
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        near = near[low[starts[order[near]] + at] == low[starts[order[near + 1]] + at]]
    new[near + 1] = False
    out = np.empty(starts.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def _repeats(groups: pd.DataFrame) -> pd.DataFrame:
    """Covered runs (doc_id, tie, start, end) of the stretches of whole buckets."""
    groups = groups.sort_values(["doc_id", "tie", "first"], ignore_index=True)
    sizes = np.fromiter(map(len, groups["data"]), np.int64, len(groups))
    offsets = np.append(0, np.cumsum(sizes))
    raw = np.frombuffer(b"".join(groups["data"]), np.uint8)
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(groups)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ids = window_classes(raw, offsets[row] + within)
    order = np.argsort(ids, kind="stable")
    again = np.zeros(ids.size, bool)
    again[order[1:]] = ids[order[1:]] == ids[order[:-1]]
    hit = np.flatnonzero(again)
    if not hit.size:
        return pd.DataFrame({"doc_id": [], "tie": [], "start": [], "end": []}, dtype=np.int64)
    new = np.ones(hit.size, bool)
    new[1:] = (row[hit[1:]] != row[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = hit[begin], hit[np.append(begin[1:], hit.size) - 1]
    base = groups["first"].to_numpy()[row[first]]
    return pd.DataFrame({"doc_id": groups["doc_id"].to_numpy()[row[first]], "tie": groups["tie"].to_numpy()[row[first]], "start": base + within[first], "end": base + within[last] + LENGTH})


def _refined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches sorted by anchor and part to covered runs; whole buckets are sorted together, some thousand stretches at a time."""
    held: list[pd.DataFrame] = []
    size = 0
    for part in parts:
        known = part["end"].to_numpy() >= 0
        if known.any():
            yield part.loc[known, ["doc_id", "tie", "first", "end"]].rename(columns={"first": "start"})
            part = part[~known]
        if not len(part):
            continue
        held.append(part)
        size += len(part)
        if size < SORTED:
            continue
        frame = pd.concat(held, ignore_index=True)
        other = np.flatnonzero((frame["anchor"].to_numpy() != frame["anchor"].iloc[-1]) | (frame["part"].to_numpy() != frame["part"].iloc[-1]))
        cut = int(other[-1]) + 1 if other.size else 0
        if cut:
            yield _repeats(frame.iloc[:cut])
        held, size = [frame.iloc[cut:]], len(frame) - cut
    if held:
        yield _repeats(pd.concat(held, ignore_index=True))


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for doc_id, tie, text, runs in zip(part["doc_id"], part["tie"], part["text"], part["runs"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, removed, spans = [], 0, 0, 0
            end = -1
            for start, stop in sorted((x["start"], x["end"]) for x in runs):
                if start > end:
                    kept.append(raw[max(at, 0) : start])
                    spans += 1
                    removed += stop - start
                    end = at = stop
                elif stop > end:
                    removed += stop - end
                    end = at = stop
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((doc_id, tie, removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        yield pd.DataFrame(rows, columns=["doc_id", "tie", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _with_texts(docs: DataFrame, shared_ids: Filter, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, tie and more) with the texts of its documents; only texts that a filter of the ids holds are shuffled."""
    near = probe(_numbered(docs, shared_ids), "doc_id", filter_of(wanted, "doc_id", FILTER_BITS)).filter("__maybe")
    texts = near.select("doc_id", "tie", "text")
    if not shared_ids.pages.isEmpty():
        texts = texts.filter("tie = 0").unionByName(texts.filter("tie <> 0").dropDuplicates(["doc_id", "tie"]))
    return texts.join(wanted, ["doc_id", "tie"])


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    shared_ids = filter_of(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "doc_id", FILTER_BITS, ids.count() // 2)
    rows = _numbered(docs, shared_ids).select("doc_id", "tie", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    copies = repeated_slots(rows)

    # One text of each group of equal ones, its owner: the rest need no sorting.
    texts = probe(_numbered(docs, shared_ids), "digest", copies)
    one = texts.filter("__maybe").groupBy("digest").agg(F.min(F.struct("doc_id", "tie", "text")).alias("x")).select("x.*")
    owners = texts.filter("not __maybe").select("doc_id", "tie", "text").unionByName(one)

    hashes = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_hash_batches, "anchor long")
    twice = stage(hashes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
    bitmap = spark.sparkContext.broadcast(filter_bytes(twice, "anchor", ANCHOR_BITS))
    stretches = stage(owners.mapInPandas(_stretches(bitmap, ANCHOR_BITS), ", ".join(f"{c} long" for c in _STRETCH)), "stretches")
    order = ["anchor", "whole", "doc_id", "tie", "first"]
    ordered = stretches.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ordered.mapInPandas(_classes, ", ".join(f"{c} long" for c in _STRETCH) + ", state int, several boolean"), "classes")
    found = stage(_settled(found), "settled")

    opened = found.filter("open").drop("open")
    # A small bucket that the filter takes for a large one is dealt out too, wholly.
    large = filter_of(opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PIECE), "anchor", FILTER_BITS)
    flagged = probe(opened, "anchor", large).withColumnRenamed("__maybe", "large")
    wanted = flagged.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "first", "last", "large")).alias("wanted"))
    pieces = _with_texts(docs, shared_ids, stage(wanted, "wanted")).mapInPandas(_bytes_of, _PIECES)
    runs = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInPandas(_refined, "doc_id long, tie long, start long, end long")
    runs = runs.unionByName(found.filter("not open").select("doc_id", "tie", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))
    by_doc = stage(runs.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")
    cut = _with_texts(docs, shared_ids, by_doc).mapInPandas(_cut, "doc_id long, tie long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    if not with_text:
        cut = cut.drop("kept_text")
    cut = stage(cut, "cut")

    # All rows: copies of an owner are wholly covered, owners without repeats are whole.
    probed = probe(rows, "digest", copies)
    some = probed.filter("__maybe").drop("__maybe")
    met = with_group(some, "digest", F.xxhash64("row"), SALTS, [F.min(F.struct("doc_id", "tie", "row")).alias("least")], [F.min("least").alias("least")])
    met = met.withColumn("owner", F.col("least.row") == F.col("row")).drop("least")
    every = probed.filter("not __maybe").drop("__maybe").withColumn("owner", F.lit(True)).unionByName(met)
    out = every.join(cut, ["doc_id", "tie"], "left")
    whole = ~F.col("owner") & (F.col("n_bytes") >= LENGTH)
    own = F.col("owner") & F.col("n_removed").isNotNull()
    return out.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(own, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept_sha256")).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).when(own, F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
