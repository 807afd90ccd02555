"""Best-fit packing with certified bin counts (operator 6).

Documents are tokenized in tasks; a document's ids end with ``END``. One longer than a sequence is cut into full
sequences with the shorter rest in front. Full pieces are sequences of their own. All other pieces are dealt to
partitions by a hash, and each partition packs its own by best-fit decreasing.

A partition then certifies its bin count: dual feasible functions map piece lengths so that any bin's images sum to at most
1, so the rounded-up sum of images is a lower bound of the bins any packing needs. Where count and bound differ,
the partition opens its gap: it gives the pieces of its emptiest bins (``spare`` per bin of gap), which partitions with gaps
exchange by dealing them to fewer, new partitions, where best-fit decreasing runs again. Rounds go on while
gaps remain and partitions can be merged, ``rounds`` at most.

Only lengths travel: pieces carry ids' checksums, not the ids. A partition's packing works on a table of pieces of bounded
size, ``piece_target`` on average, set by the number of partitions.

Defined cases: a null or empty text has the one id ``END``; a null doc_id sorts first; repeated rows are packed
each for itself; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage

LENGTH = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"

#: White space that texts are not cut at; a text that has some is tokenized whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CHUNKS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: A word of letters, alone or with one of these behind it, is one part or two.
_STOPS = frozenset(".,;:!?")
#: Different chunks, and different parts of chunks, whose ids a worker remembers, and characters of such a chunk at most.
_REMEMBERED, _SHORT = 200_000, 64
_tokenizers: dict[str, "Ids"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE has for each byte: itself where it prints, else one from 256 upwards."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids:
    """Token ids of texts as little-endian bytes.

    The tokenizer never joins white space to what stands before it, unless that is white space too. So a text is cut
    there (but a text that holds an added token, or white space of other kinds, goes to the tokenizer whole), and chunks seen before are looked up. Others are cut into the tokenizer's own parts, and parts not seen
    before go through its merges.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.letters = _byte_letters()
        self.parts_of = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.missed = 0

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            letters = part.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
            found = b"".join([x.id.to_bytes(4, "little") for x in self.tokenizer.model.tokenize(letters)])
            if len(self.parts) < _REMEMBERED and len(part) <= _SHORT:
                self.parts[part] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            found = self._part(chunk)
        elif word[-1:] in _STOPS and word[:-1].isalpha():
            found = self._part(chunk[:-1]) + self._part(word[-1])
        else:
            found = b"".join(map(self._part, self.parts_of(chunk)))
        self.missed += 1
        if len(self.known) < _REMEMBERED:
            if len(chunk) <= _SHORT:
                self.known[chunk] = found
        elif self.missed > 20 * _REMEMBERED:  # the texts may have changed: start anew
            self.known, self.parts, self.missed = {}, {}, 0
        return found

    def of(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(x in text for x in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = _CHUNKS.findall(text)
        found = list(map(self.known.get, chunks))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = self._chunk(chunks[k])
        return b"".join(found)


def _ids(path: str) -> Ids:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Ids(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, *, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids, binary) of the pieces of every row of docs (doc_id, text).

    ``row`` numbers the rows of docs. The tokenizer's file must be at the same path on every machine.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([END], "<u4").tobytes()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids(path)
        for part in parts:
            out = []
            for row, doc_id, text in zip(part["row"], part["doc_id"].astype("Int64"), part["text"], strict=True):
                data = ids.of(text or "") + end
                n = len(data) // 4
                start = 0
                stops = range(n % length or length, n + 1, length)
                for k, stop in enumerate(stops):
                    own = data[4 * start : 4 * stop]
                    out.append((doc_id, row, k, start, stop - start, zlib.crc32(own), *([own] if with_ids else [])))
                    start = stop
            frame = pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            yield frame

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInPandas(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Pieces go by falling length, each to the fullest bin with room."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = used, length
            used += 1
        bins[i], offsets[i] = b, length - room
        if room > need:
            with_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins, offsets, used


def bin_bound(lengths: np.ndarray, length: int = LENGTH) -> int:
    """Bins that any packing of the pieces needs, at least: the best of the bounds of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=length + 1)
    sizes = np.arange(length + 1)
    ceil = lambda a, b: -(-int(a) // int(b))
    best = ceil((counts * sizes).sum(), length)
    for cut in range(1, length // 2 + 1):  # pieces under the cut count nothing, those over length - cut a whole bin
        image = np.where(sizes > length - cut, length, np.where(sizes < cut, 0, sizes))
        best = max(best, ceil((counts * image).sum(), length))
    for k in range(1, 33):  # multiples of 1 / (k + 1) keep their size, others are rounded down to multiples of 1 / k
        image = np.where((k + 1) * sizes % length == 0, k * sizes, (k + 1) * sizes // length * length)
        best = max(best, ceil((counts * image).sum(), k * length))
    return best


def _packer(step: int, last: bool, length: int, spare: int):
    """An applyInPandas function that packs a partition and opens its gap, if it has one and this is not the last round."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "row", "piece"], ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, length)
        gap = 0 if last else used - bin_bound(lengths, length)
        given = np.zeros(used, bool)
        if gap:
            given[np.argsort(np.bincount(bins, lengths, used), kind="stable")[: spare * gap]] = True
        number = (step << 58) + (part["bucket"].to_numpy() << 24) + bins
        return part.assign(open=given[bins], sequence_id=number, offset=offsets)

    return run


def place(small: DataFrame, *, length: int = LENGTH, piece_target: int = 8_000, spare: int = 12, rounds: int = 4) -> DataFrame:
    """small (row, piece, length and more) with sequence_id and offset. The pieces of a bin are in one partition."""
    columns = small.columns
    schema = ", ".join(f"{n} {t}" for n, t in small.dtypes) + ", bucket long, open boolean, sequence_id long, offset long"
    n = small.count()
    done, todo = None, small
    for step in range(rounds):
        buckets = max(1, -(-n // piece_target))
        last = step == rounds - 1 or buckets == 1

        dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("row", "piece", F.lit(step)), F.lit(buckets)))
        packed = stage(dealt.groupBy("bucket").applyInPandas(_packer(step, last, length, spare), schema), "packed")
        closed = packed.filter("not open").select(*columns, "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        todo = packed.filter("open").select(*columns)
        n = todo.count()
        if not n:
            break
    return done


def certificates(packed: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """part, bins, bound of each partition of a packing (sequence_id, length): no packing of its pieces needs fewer bins than ``bound``.

    Where ``bins`` is above ``bound`` a gap was left after the last round.
    """

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": part["part"].iloc[:1], "bins": [part["sequence_id"].nunique()], "bound": [bin_bound(part["length"].to_numpy(), length)]})

    # Full pieces are alone in their sequences and need no certificate; the others' numbers name their partition.
    small = packed.filter(F.col("length") < length).select(F.shiftright("sequence_id", 24).alias("part"), "sequence_id", "length")
    return small.groupBy("part").applyInPandas(bound, "part long, bins long, bound long")


def pack(docs: DataFrame, *, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs."""
    return _pack(stage(pieces(docs, tokenizer=tokenizer, length=length), "pieces"), length).drop("row")


def _pack(cut: DataFrame, length: int) -> DataFrame:
    full = cut.filter(F.col("length") == length).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    placed = place(cut.filter(F.col("length") < length), length=length)
    return full.unionByName(placed)


def sequences(docs: DataFrame, *, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (array<int>), doc_ids of the packed sequences themselves; a sequence has ``length`` ids at most."""
    cut = stage(pieces(docs, tokenizer=tokenizer, length=length, with_ids=True), "pieces")
    placed = _pack(cut.drop("ids"), length).select("row", "piece", "sequence_id", "offset")
    joined = cut.join(placed, ["row", "piece"])

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("offset")
        ids = np.frombuffer(b"".join(part["ids"]), "<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": part["sequence_id"].iloc[:1], "ids": [ids], "doc_ids": [part["doc_id"].to_numpy()]})

    slim = joined.select("sequence_id", "offset", "ids", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))
    return slim.groupBy("sequence_id").applyInPandas(whole, "sequence_id long, ids array<int>, doc_ids array<long>")
