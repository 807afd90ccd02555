"""Substring deduplication by compact windows (operator 5): passages of 50 words or more that nearly repeat across documents.

A text is the sequence of its shingles of five words. The Cartesian tree over a text's hashes gives compact windows (l, c, r): every
passage between l and r that holds c has its least hash at c. Chains of similarity 0.8 and 50 words have ``RUN`` shingles in a row in
common, whose least one is the c of a window in both texts; ten of them, from c on or up to c, lie in the common run and name the window.

1. Windows whose names occur once are dropped through a filter of bounded size. Equal texts are taken once.
2. In groups of up to ``SMALL`` windows of a name all pairs of documents meet; in larger ones all meet two pivots, the documents of least and greatest id.
3. Windows that link two documents along near diagonals, in overlapping bands, are joined to one interval in each, with ``PAD`` more shingles on both sides.
4. Candidates are verified on their words: stretches where shingles agree are chained over the words that differ, and all
   chains of 50 words or more and a similarity of 0.8 or more are passages, the longest where one lies in another.
5. Large groups with a member that is not alike to the pivot are joined again: members meet where they share one of the ``MISSING`` + 1
   rarest shingles of ``LEAST`` in a row. Of two places alike to one pivot, or of classes that prove alike, no pair is made: they are linked through it.

Defined cases: a null or empty text, or one under 50 words, has no passages; rows with equal texts of 50 words or more are linked
whole to the one of least doc_id; rows repeated in full are one document; passages repeated inside one document alone
are not listed; rows that share a doc_id are not linked to each other; an empty table gives an empty table;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Filter, checkpoint, filter_of, probe, stage
from ._shingles import mix, shingle_hashes, word_bounds, word_hashes
from .components import components
from .exact_dedup import repeated_slots

FILTER_BITS = 1 << 26
#: Bits of the filter of repeated window hashes, 32 MB.
KEY_BITS = 1 << 28
NULL_ID = -(2**63)
WIDTH = 5
WORDS = 50
LEAST = WORDS - WIDTH + 1
#: Names of a window: the stretch from its least shingle on, and the one up to it.
HASHES = 2
ENOUGH = 2
#: Shingles in a row that two passages of similarity 0.8 have in common at least, and those of them that name a window.
RUN, STRETCH = 19, 10
#: Shingles around windows that are verified with them.
PAD = 64
#: Windows up to which all pairs of a group meet.
SMALL = 16
#: Of ``LEAST`` shingles around a common run, so many at most are not shared.
MISSING = 13
SIMILARITY = 0.8
#: Bytes of words that a task holds before it hands them on, and bytes of texts that are hashed together.
BATCH, BLOCK = 1 << 23, 1 << 19
#: Diagonals (place in one text minus place in the other) up to so far apart are always joined: words may be put in or left out.
BAND = 16
#: A band for links whose shingle repeats on both sides; no diagonal lies there.
ANY_BAND = 1 << 28
#: A shingle that does not agree counts so much against those that do: similarity 0.8 allows one in nine.
COST = 8
_SEEDS = np.random.default_rng(51).integers(1, 2**63, 4, dtype=np.uint64)


def shingles_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a text, and its bytes and its words' starts and ends in them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_bounds(raw)
    if len(starts) < WIDTH:
        return np.zeros(0, np.uint64), raw, starts, ends
    return shingle_hashes(word_hashes(raw, starts, ends), WIDTH), raw, starts, ends


def shingles_in(words: bytes) -> np.ndarray:
    """Shingle hashes of a text's bytes."""
    raw = np.frombuffer(words, np.uint8)
    starts, ends = word_bounds(raw)
    return shingle_hashes(word_hashes(raw, starts, ends), WIDTH) if len(starts) >= WIDTH else np.zeros(0, np.uint64)


def windows_of(hashes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, d, r) of the nodes of the Cartesian tree over ``hashes`` that span ``least`` places or more.

    Equal hashes with none smaller between them are one node: c is the first of their places, d the last that is the least of ``least`` places.
    """
    return windows_between(hashes, np.array([0]), np.array([hashes.size]), least)[1:]


def windows_between(hashes: np.ndarray, firsts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, l, c, d, r) of the nodes of one tree for each stretch from ``firsts`` to ``ends`` (exclusive, in order and apart)."""
    text, left, c, last, right, node = places_between(hashes, firsts, ends, least)
    own = np.flatnonzero(node == np.arange(node.size))
    return text[own], left[own], c[own], last[own], right[own]


def places_between(hashes: np.ndarray, firsts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, l, c, d, r, node) of every place that is the first least one of some ``least`` places; of a node, its first place holds l, d and r."""
    long = np.flatnonzero(ends - firsts >= least)
    if not long.size:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    low = (hashes & ~np.uint64(2**32 - 1)) | np.arange(hashes.size, dtype=np.uint64)
    span = 1
    while 2 * span <= least:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = least - span
    low = np.minimum(low[: low.size - rest], low[rest:]) if rest else low
    counts = ends[long] - firsts[long] - least + 1
    begun = np.cumsum(counts) - counts
    at = (low[np.arange(counts.sum()) + np.repeat(firsts[long] - begun, counts)] & np.uint64(2**32 - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    c, text = at[new], long[np.searchsorted(begun, new, "right") - 1]
    # What is smaller next to such a node spans even more, so the tree over these nodes has their bounds.
    places, keys, of = c.tolist(), (hashes[c] >> np.uint64(32)).tolist(), text.tolist()
    left, last, right, node, open_, before = firsts[text].tolist(), c.tolist(), (ends[text] - 1).tolist(), [], [], -1
    for i, x in enumerate(keys):
        if of[i] != before:
            before, open_ = of[i], []
        while open_ and keys[open_[-1]] > x:
            right[open_.pop()] = places[i] - 1
        if open_:
            top = open_[-1]
            if keys[top] == x:
                last[top] = places[i]
                node.append(top)
                continue
            left[i] = last[top] + 1
        open_.append(i)
        node.append(i)
    return text, np.array(left, np.int64), c, np.array(last, np.int64), np.array(right, np.int64), np.array(node, np.int64)


def _windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of whole texts. Texts are laid end to end, so that short ones cost little more than their bytes."""
    for part in parts:
        sizes, lines = [], []
        for text in part["text"]:
            lines.append((text or "").encode("utf-8", "surrogatepass"))
            sizes.append(len(lines[-1]) + 1)
        at = 0
        while at < len(sizes):
            stop, size = at + 1, sizes[at]
            while stop < len(sizes) and size + sizes[stop] <= BLOCK:
                size += sizes[stop]
                stop += 1
            raw = np.frombuffer(b" ".join(lines[at:stop]), np.uint8)
            starts, ends = word_bounds(raw)
            if len(starts) >= WIDTH:
                hashes = shingle_hashes(word_hashes(raw, starts, ends), WIDTH)
                word = np.searchsorted(starts, np.append(0, np.cumsum(sizes[at:stop])))
                yield from _rows_of(hashes, word, part["doc_id"].to_numpy()[at:stop], part["tie"].to_numpy()[at:stop])
            at = stop


def _rows_of(hashes: np.ndarray, word: np.ndarray, doc_id: np.ndarray, tie: np.ndarray) -> Iterator[pd.DataFrame]:
    """Windows of the texts that begin at the words ``word[:-1]``, with places in their own texts, and the hashes of the stretches from and to c.

    A place whose stretch would pass an end of the text has the other stretch's hash twice. Places with the same hashes less than ``LEAST`` apart are one row.
    """
    firsts, ends = word[:-1], word[1:] - WIDTH + 1
    whole = ends - firsts >= LEAST
    text, left, c, _, right, node = places_between(hashes * (_SEEDS[0] | np.uint64(1)), firsts, np.where(whole, ends, firsts), RUN)
    if not text.size:
        return
    left, right = left[node], right[node]
    keys = []
    for side, step in enumerate((1, -1)):
        key = np.zeros(c.size, np.uint64)
        for k, at in enumerate((0, WIDTH, STRETCH - 1)):  # shingles that hold all words of the stretch
            key += hashes[np.clip(c + step * at, 0, hashes.size - 1)] * (_SEEDS[1 + k] | np.uint64(1))
        keys.append(mix(key + np.uint64(side)))
    after, before = c + STRETCH <= ends[text], c - STRETCH + 1 >= firsts[text]
    ahead, back = np.where(after, keys[0], keys[1]).view(np.int64), np.where(before, keys[1], keys[0]).view(np.int64)
    order = np.lexsort((c, back, ahead, text))
    text, ahead, back, c, left, right = (x[order] for x in (text, ahead, back, c, left, right))
    changed = (text[1:] != text[:-1]) | (ahead[1:] != ahead[:-1]) | (back[1:] != back[:-1]) | (c[1:] - c[:-1] >= LEAST)
    new, end = np.flatnonzero(np.append(True, changed)), np.flatnonzero(np.append(changed, True))
    base = firsts[text[new]]
    columns = (("l", np.minimum.reduceat(left, new)), ("c", c[new]), ("d", c[end]), ("r", np.maximum.reduceat(right, new)))
    places = {name: (x - base).astype(np.int32) for name, x in columns}
    yield pd.DataFrame({"ahead": ahead[new], "back": back[new], "doc_id": doc_id[text[new]], "tie": tie[text[new]], **places})


def _slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the wanted stretches of a text, each from shingle l to shingle r."""
    names, out, held = ["doc_id", "tie", "l", "r", "words"], [], 0
    for part in parts:
        for doc_id, tie, text, wanted in zip(part["doc_id"], part["tie"], part["text"], part["wanted"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
            for w in wanted:
                own = raw[starts[w["l"]] : ends[min(w["r"] + WIDTH, len(ends)) - 1]]
                out.append((doc_id, tie, w["l"], w["r"], own))
                held += len(own)
                if held > BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
    yield pd.DataFrame(out, columns=names)


def _segments(agree: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end) of at least ``least`` places that score best, +1 where shingles agree and -COST where not."""
    out, todo = [], [(0, agree.size)] if np.count_nonzero(agree) >= least - least // (COST + 1) else []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        sums = np.append(0, np.cumsum(np.where(agree[a:b], 1, -COST)))
        gain = sums - np.minimum.accumulate(sums)
        end = int(np.argmax(gain))
        if gain[end] < least - (COST + 1) * (least // (COST + 1)):
            continue
        start = int(np.argmin(sums[: end + 1]))
        if end - start >= least:
            out.append((a + start, a + end))
        if end > start:
            todo += [(a, a + start), (a + end, b)]
    return sorted(out)


def _whole(agree: np.ndarray, least: int, cost: int = COST) -> list[tuple[int, int]]:
    """All stretches of at least ``least`` places from an agreeing place to another whose total is not negative and that lie in no longer one."""
    if np.count_nonzero(agree) < least * cost // (cost + 1):
        return []
    edges = np.empty(agree.size + 1, bool)
    edges[1:-1] = agree[1:] != agree[:-1]
    edges[0], edges[-1] = agree[0], agree[-1]
    places = np.flatnonzero(edges)
    starts, ends = places[::2], places[1::2]
    sums = np.append(0, np.cumsum(np.where(agree, 1, -cost)))
    later = np.maximum.accumulate(sums[ends][::-1])[::-1]
    last = np.searchsorted(-later, -sums[starts], "right") - 1
    far = ends[last]
    keep = (far > np.append(-1, np.maximum.accumulate(far)[:-1])) & (far - starts >= least)
    return list(zip(starts[keep].tolist(), far[keep].tolist(), strict=True))


class Sides:
    """The shingles of two stretches as small numbers, and which of them the other side holds."""

    def __init__(self, own: np.ndarray, other: np.ndarray):
        _, both = np.unique(np.concatenate((own, other)), return_inverse=True)
        self.x, self.y = both[: own.size], both[own.size :]
        self.kinds = int(both.max()) + 1 if both.size else 0
        self.nx, self.ny = np.bincount(self.x, minlength=self.kinds), np.bincount(self.y, minlength=self.kinds)
        self.agree, self.back = self.ny[self.x] > 0, self.nx[self.y] > 0

    def similarity(self, a: int, b: int, c: int, d: int) -> float:
        """Similarity of the sets of shingles a to b of the one side and c to d of the other."""
        first, second = np.zeros(self.kinds, bool), np.zeros(self.kinds, bool)
        first[self.x[a:b]] = True
        second[self.y[c:d]] = True
        return float(np.count_nonzero(first & second) / max(1, np.count_nonzero(first | second)))

    def held_by(self, a: int, b: int) -> np.ndarray:
        """The places of the other side whose shingles lie in a to b of the one side."""
        held = np.zeros(self.kinds, bool)
        held[self.x[a:b]] = True
        return held[self.y]


def _runs(sides: Sides, shortest: int) -> list[tuple[int, int, int]]:
    """(start, start, length) of the stretches of equal shingles around those that both sides hold once, by start.

    A chain lies on each side in a stretch whose own total is not negative; all else is left out before any run is built.
    """
    dense = []
    for held in (sides.agree, sides.back):
        dense.append(np.zeros(held.size, bool))
        for start, end in _whole(held, shortest, COST // 2):
            dense[-1][start:end] = True
    x, y = sides.x, sides.y
    p = np.flatnonzero((sides.nx[x] == 1) & (sides.ny[x] == 1) & dense[0])
    at = np.zeros(sides.kinds, np.int64)
    at[y] = np.arange(y.size)
    q = at[x[p]]
    inside = dense[1][q]
    p, q = p[inside], q[inside]
    first = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 1))) if p.size else np.zeros(0, np.int64)
    out, done = [], {}
    own, other = (x.tolist(), y.tolist()) if p.size else ([], [])
    for a, c, n in zip(p[first].tolist(), q[first].tolist(), np.diff(np.append(first, p.size)).tolist(), strict=True):
        if done.get(a - c, 0) > a:
            continue
        end = a + n
        while a and c and own[a - 1] == other[c - 1]:
            a, c = a - 1, c - 1
        while end < len(own) and end - a + c < len(other) and own[end] == other[end - a + c]:
            end += 1
        done[a - c] = end
        out.append((a, c, end - a))
    return sorted(out)


def _chained(sides: Sides, least: int) -> list[tuple[int, int, int, int]]:
    """Pairs of stretches (start, end, start, end) from one run of equal shingles to a later one, the longest first.

    With s shared shingles and u others on both sides together, similarity 0.8 is s >= 4 u. So a chain of runs
    counts +1 for each shared shingle and -COST / 2 for each that lies between its runs; all its stretches whose total is not
    negative are listed, not only those that score best. Stretches under ``least`` are filled up with what lies next to them.
    """
    runs = _runs(sides, least - least // (COST + 1))
    if not runs:
        return []
    half, found = COST // 2, set()
    a_, c_, n_ = (list(t) for t in zip(*runs, strict=True))
    b_, d_ = [x + n for x, n in zip(a_, n_, strict=True)], [y + n for y, n in zip(c_, n_, strict=True)]
    b, c, d, score, links, steps = np.array(b_), np.array(c_), np.array(d_), np.array(n_), [], []
    for j in range(len(runs)):
        before, step = -1, 0
        ahead = np.flatnonzero((c[:j] < c_[j]) & (b[:j] < b_[j]) & (d[:j] < d_[j])) if j else ()
        if len(ahead):
            dx, dy = a_[j] - b[ahead], c_[j] - d[ahead]
            cost = -half * (np.maximum(dx, 0) + np.maximum(dy, 0)) - np.maximum(np.maximum(-dx, -dy), 0)
            k = int(np.argmax(score[ahead] + cost))
            before, step = int(ahead[k]), int(cost[k])
            score[j] += max(0, int(score[before]) + step)
        links.append(before)
        steps.append(step)
        i, total, end, stop = j, n_[j], b_[j], d_[j]
        while True:
            fill = max(0, least - min(end - a_[i], stop - c_[i]))
            if total >= COST * fill:
                right = min(fill, sides.x.size - end, sides.y.size - stop)
                left = min(fill - right, a_[i], c_[i])
                if right + left == fill:
                    found.add((a_[i] - left, end + right, c_[i] - left, stop + right))
            # What lies before can add one for each of its shingles at most.
            if links[i] < 0 or total + steps[i] + a_[i] < 0:
                break
            total += steps[i] + n_[links[i]]
            i = links[i]
    return sorted(found, key=lambda t: (t[0] - t[1] + t[2] - t[3], t))


def passages(x: bytes, y: bytes, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, similarity) of near-duplicate passages of two stretches of words, in words, ends exclusive.

    Passages may overlap; one that lies in another on both sides is not listed.
    """
    return passages_between(*(shingles_of(t.decode("utf-8", "surrogatepass"))[0] for t in (x, y)), least, similarity)


def passages_between(own: np.ndarray, other: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """What ``passages`` finds, of the shingles of both stretches."""
    sides = Sides(own, other)
    if min(own.size, other.size) >= least and sides.x[0] == sides.y[0] and sides.x[-1] == sides.y[-1]:
        like = sides.similarity(0, own.size, 0, other.size)
        if like >= similarity:  # stretches alike as a whole hold every other passage
            return [(0, own.size + WIDTH - 1, 0, other.size + WIDTH - 1, like)]
    out = []

    def put(a: int, b: int, c: int, d: int) -> None:
        if any(p <= a and b <= q and r <= c and d <= s for p, q, r, s, _ in out):
            return
        like = sides.similarity(a, b, c, d)
        if like >= similarity:
            out[:] = [t for t in out if not (a <= t[0] and t[1] <= b and c <= t[2] and t[3] <= d)]
            out.append((a, b, c, d, like))

    for t in _chained(sides, least):
        put(*t)
    # Words in another order make no chain: stretches of each side by what the other side holds at any place.
    left = []
    for a, b in _whole(sides.agree, least):
        places = np.flatnonzero(sides.held_by(a, b))
        if not any(p <= a and b <= q and r <= places[0] and places[-1] < s for p, q, r, s, _ in out):
            left.append((a, b))
    if left:  # each segment lies in one of the whole stretches
        for a, b in {*left, *_segments(sides.agree, least)}:
            again = sides.held_by(a, b)
            for c, d in {*_segments(again, least), *_whole(again, least)}:
                put(a, b, c, d)
    return sorted((a, b + WIDTH - 1, c, d + WIDTH - 1, like) for a, b, c, d, like in out)


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: tuple[bytes, np.ndarray] | None = None
    for part in parts:
        out = []
        for row in part.itertuples(index=False):
            if known is None or known[0] != row.wy:  # many candidates of a pivot follow one another
                known = row.wy, shingles_in(row.wy)
            own = known[1] if row.wx == row.wy else shingles_in(row.wx)
            for a, b, c, d, like in passages_between(own, known[1]):
                out.append((row.x, row.lx + a, row.lx + b, row.y, row.ly + c, row.ly + d, round(like, 6), row.n_hashes, row.tiex, row.tiey))
        yield pd.DataFrame(out, columns=["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity", "n_hashes", "tiex", "tiey"])


def candidates_of(links: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Pairs of intervals in which at least ``enough`` hash functions agree, of links (j, and doc_id, tie, l, c, d, r with x and y).

    Links are summed in bands of ``BAND`` diagonals; each band is joined to the one below and to the one above, so links up
    to ``BAND`` diagonals apart always meet. A link whose shingle repeats in a window lies in the bands of its first and last
    places, and where it repeats in both windows, it agrees with others of its kind on any diagonal.
    Stretches far apart on a diagonal are told apart when they are verified.
    """
    pair = ["doc_idx", "tiex", "doc_idy", "tiey"]
    ends = [F.min("lx").alias("lx"), F.max("rx").alias("rx"), F.min("ly").alias("ly"), F.max("ry").alias("ry")]
    bands = [F.floor((F.col(x) - F.col(y)) / BAND).cast("int") for x in ("cx", "dx") for y in ("cy", "dy")]
    any_ = F.when((F.col("cx") < F.col("dx")) & (F.col("cy") < F.col("dy")), F.lit(ANY_BAND)).otherwise(bands[0])
    listed = links.select(*pair, "j", "lx", "rx", "ly", "ry", F.explode(F.array_distinct(F.array(*bands, any_))).alias("band"))
    single = listed.groupBy(*pair, "band").agg(*ends, F.expr("bit_or(shiftleft(1, j))").alias("agree"))
    both = single.select(*pair, "lx", "rx", "ly", "ry", "agree", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    joined = both.groupBy(*pair, "band").agg(*ends, F.bit_count(F.bit_or("agree")).alias("n_hashes")).filter(F.col("n_hashes") >= enough)
    # A band with empty neighbours comes twice.
    return joined.groupBy(*pair, "lx", "rx", "ly", "ry").agg(F.max("n_hashes").alias("n_hashes"))


def _links(met: DataFrame, pad: int) -> DataFrame:
    """Links of two sides (j, and doc_id, tie, l, c, d, r with and without _y), the greater document first, with ``pad`` more shingles around each window."""
    turned = F.col("doc_id") < F.col("doc_id_y")
    sides = [F.when(turned, F.col(f"{c}_y")).otherwise(F.col(c)).alias(f"{c}x") for c in ("doc_id", "tie", "l", "c", "d", "r")]
    others = [F.when(turned, F.col(c)).otherwise(F.col(f"{c}_y")).alias(f"{c}y") for c in ("doc_id", "tie", "l", "c", "d", "r")]
    wider = {f"l{s}": F.greatest(F.col(f"l{s}") - pad, F.lit(0)) for s in "xy"} | {f"r{s}": F.col(f"r{s}") + pad for s in "xy"}
    return met.select("j", *sides, *others).withColumns(wider)


def _texts_of(wanted: DataFrame, named: DataFrame, shared_ids: Filter) -> DataFrame:
    """wanted (doc_id, tie, wanted), with the texts. Only texts of documents that may be wanted are shuffled."""
    near = probe(named, "doc_id", filter_of(wanted, "doc_id", FILTER_BITS)).filter("__maybe").select("doc_id", "tie", "text")
    if not shared_ids.pages.isEmpty():
        near = near.filter("tie = 0").unionByName(near.filter("tie <> 0").dropDuplicates(["doc_id", "tie"]))
    # The same plan at every size: a few wanted stretches would be broadcast, more would not.
    return wanted.hint("merge").join(near, ["doc_id", "tie"])


def _verified(candidates: DataFrame, named: DataFrame, shared_ids: Filter) -> DataFrame:
    """The passages of candidates, each once: doc_id, tiex, start, end, other_id, tiey, other_start, other_end, similarity, n_hashes."""
    # A text is cut once for all its candidates, however many documents share a stretch.
    ends = [candidates.select(*[F.col(f"{c}{s}").alias(c) for c in ("doc_id", "tie", "l", "r")]) for s in "xy"]
    wanted = ends[0].unionByName(ends[1]).distinct().groupBy("doc_id", "tie").agg(F.collect_list(F.struct("l", "r")).alias("wanted"))
    cut = _texts_of(stage(wanted, "wanted"), named, shared_ids).mapInPandas(_slices, "doc_id long, tie long, l int, r int, words binary")
    cut = stage(cut, "slices")
    both = candidates
    for s in "xy":
        both = both.join(cut.select(*[F.col(c).alias(f"{c}{s}") for c in ("doc_id", "tie", "l", "r")], F.col("words").alias(f"w{s}")), [f"{c}{s}" for c in ("doc_id", "tie", "l", "r")])
    both = both.withColumnsRenamed({"doc_idx": "x", "doc_idy": "y"})
    schema = "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double, n_hashes int"
    # Overlapping bands find a passage twice.
    found = both.mapInPandas(_verify, f"{schema}, tiex long, tiey long").groupBy("doc_id", "tiex", "start", "end", "other_id", "tiey", "other_start", "other_end", "similarity")
    return stage(found.agg(F.max("n_hashes").alias("n_hashes")), "passages")


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, tie, at, items, words): the shingles and words of the stretches in which a wanted place and ``LEAST`` shingles lie."""
    for part in parts:
        out = []
        for doc_id, tie, text, wanted in zip(part["doc_id"], part["tie"], part["text"], part["wanted"], strict=True):
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            words = word_hashes(raw, *word_bounds(raw))
            items, words = shingle_hashes(words, WIDTH).view(np.int64), words.view(np.int64)
            places = np.sort(np.asarray(wanted, np.int64))
            parted = np.flatnonzero(np.diff(places) >= 2 * LEAST - 1) + 1
            for own in np.split(places, parted):
                start = max(0, int(own[0]) - LEAST + 1)
                end = min(items.size, int(own[-1]) + LEAST)
                out.append((doc_id, tie, start, items[start:end], words[start : end + WIDTH - 1]))
        yield pd.DataFrame(out, columns=["doc_id", "tie", "at", "items", "words"])


def rare_places(counts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Places whose shingle is among the ``MISSING`` + 1 rarest of ``LEAST`` shingles in a row, of which all but ``MISSING`` are in two documents or more.

    ``counts`` are the documents that hold each of ``items``. Of two such stretches that share all but ``MISSING`` shingles of each, one of
    these rarest is shared: those of the one that come before the first shared one are not in the other, nor the other way round.
    Similarity is one of sets, so where shingles repeat in a stretch, the same share of its different ones may be missing: a run of one word, cut
    off by others that no document has, is in no passage.
    """
    if items.size < LEAST:
        return np.zeros(0, np.int64)
    order = np.lexsort((items, counts))
    rank = np.empty(items.size, np.int64)
    changed = (items[order][1:] != items[order][:-1]) | (counts[order][1:] != counts[order][:-1])
    rank[order] = np.cumsum(np.append(0, changed.astype(np.int64)))
    single = np.count_nonzero(counts[order] < 2)
    first_known = int(rank[order[single]]) if single < items.size else items.size
    rows = np.sort(np.lib.stride_tricks.sliding_window_view(rank, LEAST), axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    alone = np.count_nonzero(new & (rows < first_known), axis=1)
    most = MISSING * np.count_nonzero(new, axis=1) // LEAST
    upto = np.where(np.cumsum(new, axis=1) <= most[:, None] + 1, rows, -1).max(axis=1)
    upto = np.where(alone <= most, upto, -1)
    filled = np.concatenate((np.full(LEAST - 1, -1), upto, np.full(LEAST - 1, -1)))
    highest = np.lib.stride_tricks.sliding_window_view(filled, LEAST).max(axis=1)
    return np.flatnonzero((rank <= highest) & (rank >= first_known))


def _gap(words: np.ndarray, a: int, b: int) -> int:
    """What the gap of shingles a to b costs a chain on its other side at least: WIDTH - 1 shingles lie between the runs there, fewer only where words before and after agree."""
    least = (WIDTH - 1) * COST // 2
    for i in range(WIDTH - 1):
        for j in range(WIDTH - 1 - i):  # runs that end i shingles before the gap and begin j after it
            for k in range(1, WIDTH):
                cost = (COST // 2 + 1) * (i + j) + COST // 2 * (WIDTH - 1 - k)
                before, after = a + WIDTH - 1 - i, b + j
                if cost < least and before >= k and np.array_equal(words[before - k : before], words[after : after + k]):
                    least = cost
    return least


def chainable(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The shingles that can lie in a chain whose total is not negative, where those not ``known`` are in no other document."""
    out, value = np.zeros(known.size, bool), np.where(known, 1, -COST // 2)
    places = np.flatnonzero(np.diff(np.concatenate(([False], known, [False]))))
    starts, ends = places[::2], places[1::2]
    if not starts.size:
        return out
    for a, b in zip(ends[:-1].tolist(), starts[1:].tolist(), strict=True):
        value[a] -= _gap(words, a, b)
    sums = np.append(0, np.cumsum(value))
    later = np.maximum.accumulate(sums[ends][::-1])[::-1]
    far = ends[np.searchsorted(-later, -sums[starts], "right") - 1]
    # A chain is filled up by one shingle in nine at most.
    for start, end in zip(starts.tolist(), far.tolist(), strict=True):
        if end - start >= LEAST - LEAST // (COST + 1):
            out[start:end] = True
    return out


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, doc_id, tie, c, d, common) of the rare places of stretches (doc_id, tie, at, size, known: place, item, n of the shingles that repeat).

    Places of a shingle less than ``LEAST`` apart are one row; ``common`` is in how many documents the shingles around it are, summed.
    """
    for part in parts:
        out = []
        for doc_id, tie, at, size, known, words in zip(part["doc_id"], part["tie"], part["at"], part["size"], part["known"], part["words"], strict=True):
            if len(known) < LEAST - MISSING:
                continue
            counts, items = np.ones(size, np.int64), np.arange(size, dtype=np.int64)
            place = np.array([k["place"] for k in known], np.int64)
            counts[place], items[place] = [k["n"] for k in known], [k["item"] for k in known]
            rare = rare_places(counts, items)
            rare = rare[chainable(counts > 1, words)[rare]]
            rare = rare[np.lexsort((rare, items[rare]))]
            parted = np.flatnonzero((np.diff(items[rare]) != 0) | (np.diff(rare) >= LEAST)) + 1
            sums = np.append(0, np.cumsum(counts * (counts > 1)))
            for own in np.split(rare, parted):
                if own.size:
                    around = sums[min(size, own[-1] + LEAST)] - sums[max(0, own[0] - LEAST + 1)]
                    out.append((items[own[0]], doc_id, tie, at + own[0], at + own[-1], around))
        yield pd.DataFrame(out, columns=["item", "doc_id", "tie", "c", "d", "common"])


def _merged(labelled: DataFrame, named: DataFrame, shared_ids: Filter) -> tuple[DataFrame, DataFrame] | None:
    """Join classes: the most common place of each class of a shingle, which few words set apart, is held against that of the largest class.

    (labelled, new passages), or None if no shingle has two classes.
    """
    place = F.struct("common", "doc_id", "tie", "c", "d")
    classes = checkpoint(labelled.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("rep")))
    top = classes.groupBy("item").agg(F.max(F.struct("n", "label", "rep")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = classes.join(top, "item").filter((F.col("label") != F.col("top.label")) & (F.col("rep.doc_id") != F.col("top.rep.doc_id")))
    sides = [F.col(f"{of}.{a}").alias(f"{b}{end}") for of, end in (("rep", ""), ("top.rep", "_y")) for a, b in (("doc_id", "doc_id"), ("tie", "tie"), ("c", "l"), ("c", "c"), ("d", "d"), ("d", "r"))]
    candidates = stage(candidates_of(_links(met.select(F.lit(0).alias("j"), *sides), PAD), 1), "classes")
    if candidates.isEmpty():
        return None
    found = _verified(candidates, named, shared_ids)
    over = lambda e, start, end: (F.col(start) - PAD <= F.col(f"{e}.c")) & (F.col(f"{e}.d") + WIDTH <= F.col(end) + PAD)
    x, y, p = labelled.alias("x"), labelled.alias("y"), found.alias("p")
    one = x.join(p, (F.col("x.doc_id") == F.col("p.doc_id")) & (F.col("x.tie") == F.col("p.tiex")) & over("x", "p.start", "p.end"))
    both = one.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("y.doc_id") == F.col("p.other_id")) & (F.col("y.tie") == F.col("p.tiey")) & over("y", "p.other_start", "p.other_end"))
    named_ = lambda e: F.xxhash64(F.col(f"{e}.item"), F.col(f"{e}.label"))
    edges = both.filter(F.col("x.label") != F.col("y.label")).select(named_("x").alias("u"), named_("y").alias("v"))
    joined = components(edges).withColumnsRenamed({"node": "id"})
    again = labelled.withColumn("id", F.xxhash64("item", "label")).join(joined, "id", "left").withColumn("label", F.coalesce("component", "label")).drop("id", "component")
    return stage(again, "labelled"), found


def _across(members: DataFrame, passages_: DataFrame, named: DataFrame, shared_ids: Filter) -> list[DataFrame]:
    """Further passages among the members of large groups, some of which are not alike to the group's pivot.

    Members meet where they share one of the rarest shingles around their places, so a line that thousands have makes no pairs of
    those that have nothing else in common. The places of a shingle that are alike to one pivot are a class, classes that prove alike
    are joined, and all places meet those of other classes.
    """
    names = ("doc_id", "tie", "start", "last", "other")
    cover = passages_.select("doc_id", F.col("tiex").alias("tie"), "start", (F.col("end") - WIDTH).alias("last"), F.col("other_id").alias("other"))
    turned = passages_.select(F.col("other_id").alias("doc_id"), F.col("tiey").alias("tie"), F.col("other_start").alias("start"), (F.col("other_end") - WIDTH).alias("last"), F.col("doc_id").alias("other"))
    cover = cover.unionByName(turned).select(*names)
    big = members.filter((F.col("n") > SMALL) & (F.col("doc_id") != F.col("low"))).alias("m")
    at = cover.alias("p")
    like = (F.col("m.doc_id") == F.col("p.doc_id")) & (F.col("m.tie") == F.col("p.tie")) & (F.col("m.low") == F.col("p.other")) & (F.col("p.start") <= F.col("m.c")) & (F.col("m.d") <= F.col("p.last"))
    open_ = checkpoint(big.join(at, like, "left_anti").select("key").distinct())
    if open_.isEmpty():
        return []
    some = stage(members.join(open_, "key").select("doc_id", "tie", "c", "d", "low", "high"), "open")
    wanted = some.select("doc_id", "tie", F.explode(F.array("c", "d")).alias("place")).distinct().groupBy("doc_id", "tie").agg(F.collect_list("place").alias("wanted"))
    contexts = stage(_texts_of(stage(wanted, "wanted"), named, shared_ids).mapInPandas(_contexts, "doc_id long, tie long, at int, items array<long>, words array<long>"), "contexts")
    counts = contexts.select("doc_id", F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    counts = stage(counts.filter("a < b").select("item", "n"), "counts")
    placed = contexts.select("doc_id", "tie", "at", F.size("items").alias("size"), F.posexplode("items").alias("place", "item")).join(counts, "item")
    known = placed.groupBy("doc_id", "tie", "at", "size").agg(F.collect_list(F.struct("place", "item", "n")).alias("known"))
    known = known.join(contexts.select("doc_id", "tie", "at", "words"), ["doc_id", "tie", "at"])
    entries = stage(known.mapInPandas(_entries, "item long, doc_id long, tie long, c int, d int, common long"), "entries")

    # The class of a place is a pivot that is alike there, or else one that has its shingle and is alike next to it, or else its own document.
    pivots = checkpoint(some.select(F.explode(F.array("low", "high")).alias("pivot")).distinct())
    reps = stage(cover.join(pivots, cover["other"] == pivots["pivot"], "left_semi"), "covers")
    e, r = entries.alias("e"), reps.alias("r")

    def over(by: int) -> Column:
        return (F.col("e.doc_id") == F.col("r.doc_id")) & (F.col("e.tie") == F.col("r.tie")) & (F.col("r.start") - by <= F.col("e.c")) & (F.col("e.d") <= F.col("r.last") + by)

    met = e.join(r, over(0), "left").select("e.*", "r.other").join(pivots.withColumnRenamed("pivot", "doc_id").withColumn("own", F.col("doc_id")), "doc_id", "left")
    placed = stage(met.groupBy("item", "doc_id", "tie", "c", "d", "common").agg(F.least(F.min("other"), F.min("own")).alias("label")), "placed")
    alone = placed.filter("label is null").drop("label").alias("e")
    held = contexts.join(pivots.withColumnRenamed("pivot", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("other"), F.explode(F.array_distinct("items")).alias("item"))
    held = held.join(alone.select("item").distinct(), "item", "left_semi").distinct()
    beside = alone.join(r, over(PAD)).select("e.*", "r.other").distinct().join(held, ["item", "other"]).groupBy("item", "doc_id", "tie", "c", "d", "common").agg(F.min("other").alias("label"))
    own = alone.join(beside, ["item", "doc_id", "tie", "c", "d"], "left_anti").withColumn("label", F.col("doc_id"))
    labelled = stage(reduce(DataFrame.unionByName, (beside, own), placed.filter("label is not null")), "labelled")
    more = []
    merged = _merged(labelled, named, shared_ids)
    if merged is not None:
        labelled, found = merged
        more.append(found)
    labels = labelled.select("item", "label").distinct()
    mixed = labels.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item")
    labels = stage(labels.join(mixed, "item"), "labels")
    across = labels.join(labels.withColumnRenamed("label", "label_y"), "item").filter(F.col("label") < F.col("label_y"))
    sides = labelled.select("item", "label", "doc_id", "tie", F.col("c").alias("l"), "c", "d", F.col("d").alias("r"))
    others = sides.select("item", *[F.col(c).alias(f"{c}_y") for c in sides.columns if c != "item"])
    pairs = across.join(sides, ["item", "label"]).join(others, ["item", "label_y"]).filter(F.col("doc_id") != F.col("doc_id_y"))
    links = _links(pairs.withColumn("j", F.lit(0)), PAD).alias("k")
    p = reduce(DataFrame.unionByName, more, passages_).alias("p")
    same = [F.col(f"k.{a}") == F.col(f"p.{b}") for a, b in (("doc_idx", "doc_id"), ("tiex", "tiex"), ("doc_idy", "other_id"), ("tiey", "tiey"))]
    inside = [F.col("p.start") <= F.col("k.cx"), F.col("k.dx") + WIDTH <= F.col("p.end"), F.col("p.other_start") <= F.col("k.cy"), F.col("k.dy") + WIDTH <= F.col("p.other_end")]
    return [*more, _verified(stage(candidates_of(links.join(p, reduce(and_, same + inside), "left_anti"), 1), "across"), named, shared_ids)]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end (words, ends exclusive), similarity, n_hashes.

    One row per passage of a document and passage of its pivot; rows with equal texts have one with the least doc_id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    digests = stage(base.select("doc_id", "digest").distinct(), "digests")
    copies = repeated_slots(digests)
    shared_ids = filter_of(digests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "doc_id", FILTER_BITS, digests.count() // 2)
    named = probe(base, "doc_id", shared_ids).withColumn("tie", F.when(F.col("__maybe"), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))).drop("__maybe")
    owner = digests.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "owner")
    owner = checkpoint(owner)

    probed = probe(named, "digest", copies)
    one = probed.filter("__maybe").groupBy("digest").agg(F.min(F.struct("doc_id", "tie", "text")).alias("x")).select("x.*")
    owners = probed.filter("not __maybe").select("doc_id", "tie", "text").unionByName(one)

    windows = stage(owners.mapInPandas(_windows, "ahead long, back long, doc_id long, tie long, l int, c int, d int, r int"), "windows")
    twice = windows.select(F.explode(F.array("ahead", "back")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = F.array(F.struct(F.lit(0).alias("j"), F.col("ahead").alias("key")), F.struct(F.lit(1).alias("j"), F.col("back").alias("key")))
    rows = windows.select(F.explode(keys).alias("of"), "doc_id", "tie", "l", "c", "d", "r").select("of.*", "doc_id", "tie", "l", "c", "d", "r")
    rows = stage(probe(rows, "key", filter_of(twice, "key", KEY_BITS, windows.count())).filter("__maybe").drop("__maybe"), "repeated")

    several = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    several = stage(several, "keys")
    members = stage(rows.join(several, "key"), "members")
    # In a small group all members meet, in a large one each meets the two pivots; the pivots themselves meet once.
    pivot = F.when(F.col("n") <= SMALL, 0).when(F.col("doc_id") == F.col("low"), 1).when(F.col("doc_id") == F.col("high"), 2)
    others = members.withColumn("role", pivot).filter("role is not null").select("key", *[F.col(c).alias(f"{c}_y") for c in ("role", "doc_id", "tie", "l", "c", "d", "r")])
    links = members.join(others, "key").filter(
        F.when(F.col("role_y") == 0, F.col("doc_id") > F.col("doc_id_y")).otherwise((F.col("doc_id") != F.col("doc_id_y")) & ((F.col("role_y") == 1) | (F.col("doc_id") != F.col("low"))))
    )
    passages_ = _verified(stage(candidates_of(_links(links, PAD), 1), "candidates"), named, shared_ids)
    passages_ = reduce(DataFrame.unionByName, _across(members, passages_, named, shared_ids), passages_)
    names = ("doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity", "n_hashes")
    found = passages_.groupBy("tiex", "tiey", *names[:-1]).agg(F.max("n_hashes").alias("n_hashes")).select(*names)

    # Rows with equal texts: each but the first is linked to it whole.
    # Words are counted of rows that may be repeated alone: the condition on n would else be pushed below the probe.
    words = F.when(F.col("__maybe"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    copied = probe(base, "digest", copies).select("doc_id", "digest", words.alias("n")).filter("n is not null").distinct()
    copied = copied.filter(F.col("n") >= WORDS).join(owner, "digest").filter(F.col("doc_id") != F.col("owner"))
    zero = F.lit(0).cast("long")
    whole = copied.select("doc_id", zero.alias("start"), F.col("n").alias("end"), F.col("owner").alias("other_id"), zero.alias("other_start"), F.col("n").alias("other_end"), F.lit(1.0).alias("similarity"), F.lit(HASHES).alias("n_hashes"))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return found.unionByName(whole).select(known("doc_id"), "start", "end", known("other_id"), "other_start", "other_end", "similarity", "n_hashes")
