"""Statistics of whole documents, computed in tasks over Arrow batches, for the quality rules and the classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = b"#*$%&|<>"

#: Names of the features, in the order of the arrays.
FEATURES = (
    "log_words", "mean_word", "log_lines", "words_per_line", "symbol_share", "duplicate_line_share", "repeated_word_share",
    "distinct_word_share", "distinct_window_share", "upper_share", "digit_share", "exclamation_share", "punctuation_share",
    "non_ascii_share", "space_share", "pipe_share", "short_word_share", "long_word_share", "top_word_share", "byte_entropy", "echo_share",
)
#: Labels that are learnt: rows with crc32(doc_id as text) mod 5 = 0 are held out.
LEARNT = "quality is not null and crc32(cast(doc_id as string)) % 5 <> 0"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more in the text, and the number of different windows."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0, len(counts)
    total, end = 0, 0
    for i, x in enumerate(windows):
        if counts[x] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total, len(counts)


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts and the features of a text; null counts as a text without words."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    lines = text.split("\n")
    worded = [x for x in lines if x and not x.isspace() or _WORDS.search(x)]
    duplicates = len(worded) - len(set(worded))
    repeats, windows = repeated_words(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size, chars = max(1, raw.size), sum(map(len, words))
    symbols = int(counts[list(SYMBOLS)].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    per_word = max(1, n)
    share = counts[counts > 0] / size
    common = Counter(words)
    return [n, chars, symbols, duplicates, repeats], [
        np.log1p(n), chars / per_word, np.log1p(len(worded)), n / max(1, len(worded)), symbols / size, duplicates / max(1, len(worded)), repeats / per_word,
        len(common) / per_word, windows / max(1, n - 2), counts[65:91].sum() / size, counts[48:58].sum() / size, counts[33] / size,
        counts[[44, 46, 58, 59, 63]].sum() / size, counts[128:].sum() / size, counts[[32, 9, 10, 13]].sum() / size, counts[124] / size,
        (lengths <= 3).sum() / per_word, (lengths >= 15).sum() / per_word, max(common.values(), default=0) / per_word, float(-(share * np.log2(share)).sum()), sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
    ]


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [describe(x) for x in part["text"]]
        out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64")})
        for k, name in enumerate(BASE):
            out[name] = np.fromiter((x[0][k] for x in found), np.int64, len(found))
        out["features"] = [np.asarray(x[1], np.float32) for x in found]
        if "row" in part:
            out["row"] = part["row"]
        yield out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and ``features`` (array<float>) of every row of docs (doc_id, text); the text is read once."""
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", features array<float>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_batches, schema)


def labelled_sample(stats: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality labels of at most ``max_rows`` labelled rows, chosen by a hash of doc_id.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are never learnt.
    """
    truth = labels.filter(LEARNT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.select("doc_id", "features").join(truth, "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("features", "quality").toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.stack(rows["features"].to_list()).astype(np.float32), rows["quality"].to_numpy(float)


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cut points at quantiles; a value's bin is the number of cut points below it."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) if len(x) else np.zeros(0, np.float32)
