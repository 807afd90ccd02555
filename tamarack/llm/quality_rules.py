"""Quality rules (operator 1): gradient-boosted trees over document statistics, as flat numpy arrays of nodes.

Statistics are made in one pass over the texts and staged. The trees are fitted on a bounded sample of labelled
rows (``max_rows``), with second-order boosting over binned features; chosen features are monotone: a split whose
leaves would break the order is not made, and the middle of its leaves bounds all that grows below it. Scoring
walks all rows of a batch down a tree at once: one array lookup per level.

Defined cases: a null or empty text has no words and fails the base rule; a null doc_id stays null; without
labels of both kinds every score is the share of label 1 (0.5 without labels), so only the base rule rejects;
repeated rows are judged alike, each for itself; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stats import BASE, FEATURES, LEARNT, edges_of, labelled_sample, statistics
from ._common import stage

#: Features along which the score may only fall.
MONOTONE = {"symbol_share": -1, "duplicate_line_share": -1, "repeated_word_share": -1}
MIN_SCORE = 0.3
MAX_ROWS = 20_000


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own left and right child."""

    prior: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        k = len(self.value)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            column.append(x)
        return k


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: Mapping[int, int], *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, min_weight: float = 2.0) -> Trees:
    """Boost ``trees`` trees on the logistic loss. ``monotone``: feature index to +1 (rising) or -1 (falling)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    nodes, roots, prior = _Nodes(), [], float(np.log(share / (1 - share)))
    if len(y) and y.min() < y.max():
        edges = [edges_of(x[:, j], bins) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        flat = codes + np.arange(x.shape[1]) * bins
        sign = np.array([monotone.get(j, 0) for j in range(x.shape[1])])
        usable = np.arange(bins)[None, :] < np.array([len(e) for e in edges])[:, None]
        margin = np.full(len(y), prior)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            here = float(np.clip(-gs / (hs + ridge), low, high))
            node = nodes.leaf(rate * here)
            if level < depth and len(rows) > 1:
                at = flat[rows].ravel()
                shape, size = (x.shape[1], bins), x.shape[1] * bins
                gl = np.bincount(at, np.repeat(g[rows], x.shape[1]), size).reshape(shape).cumsum(1)
                hl = np.bincount(at, np.repeat(h[rows], x.shape[1]), size).reshape(shape).cumsum(1)
                vl, vr = (np.clip(-a / (b + ridge), low, high) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + ridge) * vr**2 / 2) + gs * here + (hs + ridge) * here**2 / 2
                gain[~usable | (hl < min_weight) | (hs - hl < min_weight) | (sign[:, None] * (vr - vl) < 0)] = -np.inf
                j, k = np.unravel_index(np.argmax(gain), shape)
                if gain[j, k] > 1e-6:
                    middle = (vl[j, k] + vr[j, k]) / 2
                    bounds = [(low, high)] * 2 if not sign[j] else [(low, middle), (middle, high)] if sign[j] > 0 else [(middle, high), (low, middle)]
                    goes = codes[rows, j] <= k
                    nodes.feature[node], nodes.threshold[node] = int(j), float(edges[j][k])
                    nodes.left[node] = grow(rows[goes], g, h, level + 1, *bounds[0])
                    nodes.right[node] = grow(rows[~goes], g, h, level + 1, *bounds[1])
            return node

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
            one = Trees(0.0, depth, np.array(roots[-1:]), *(np.array(c) for c in (nodes.feature, nodes.threshold, nodes.left, nodes.right, nodes.value)))
            margin += one.margin(x)
    if not nodes.value:
        nodes.leaf(0.0)
    arrays = (np.array(nodes.feature, np.int32), np.array(nodes.threshold, np.float32), np.array(nodes.left, np.int32), np.array(nodes.right, np.int32), np.array(nodes.value))
    return Trees(prior, depth, np.array(roots, np.int32), *arrays)


def fit_rules(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    x, y = labelled_sample(stats, labels, max_rows)
    return fit_trees(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def score_batches(model, column: str):
    """A mapInPandas function that puts the model's score of ``features`` in their place."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["features"].to_list()).astype(np.float32) if len(part) else np.zeros((0, len(FEATURES)), np.float32)
            yield part.drop(columns="features").assign(**{column: model.score(x)})

    return run


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, min_score: float = MIN_SCORE, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, tree_score of every row of docs."""
    stats = stage(statistics(docs), "statistics")
    model = fit_rules(stats, labels, max_rows)
    base = ", ".join(f"{x} long" for x in BASE)
    scored = stats.mapInPandas(score_batches(model, "tree_score"), f"doc_id long, {base}, tree_score double")
    failed = _base_failed()
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("tree_score") >= min_score)).alias("kept"), "tree_score")


def keep_good(docs: DataFrame, labels: DataFrame, *, min_score: float = MIN_SCORE, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    The model comes from a first pass over a bounded sample of labelled rows, the one that ``quality_rules`` takes; each row is then judged where
    its text is read, so no text is shuffled.
    """
    held = labels.filter(LEARNT).select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows ids at most, so the broadcast is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    model = fit_rules(statistics(sample), labels, max_rows)
    verdict = _verdict(model, min_score)
    return docs.filter(verdict(F.col("text")))


def _verdict(model: Trees, min_score: float):
    from ._stats import describe

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        found = [describe(x) for x in texts]
        if not found:
            return pd.Series([], dtype=bool)
        n, repeats = (np.array([x[0][k] for x in found]) for k in (0, 4))
        score = model.score(np.array([x[1] for x in found], np.float32))
        return pd.Series((n >= 50) & (100 * repeats <= 50 * n) & (score >= min_score))

    return kept
