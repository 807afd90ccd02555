"""Quality classifier (operator 8): a generalised additive model with pairwise interactions.

Each feature has a table of values over its bins, learnt by cyclic boosting: round after round, every feature in
turn gets a shallow tree over its own bins, fitted to what is left, at a small rate. Then the pairs whose best
quadrant cut explains most of the rest get tables of their own, boosted the same way. A document's score is the
sum of table entries, one per feature and pair, through the logistic function.

Defined cases: null and empty texts are scored from the statistics of a text without words; a null doc_id stays
null and is not held out; without labels of both kinds the score is the share of label 1 (0.5 without labels);
repeated rows get the same score; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage
from ._stats import edges_of, labelled_sample, statistics
from .quality_rules import score_batches

THRESHOLD = 0.3
MAX_ROWS = 20_000


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j])]
        cells = {j: np.searchsorted(self.coarse[j], x[:, j]) for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[cells[i], cells[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with sums g and h (the last axis); place -1: none."""
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gs, hs = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
    gain[(hl < least) | (hs - hl < least)] = -1
    k = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[k]), k) if k >= 0 and gain[k] > 1e-9 else (0.0, -1)


def _steps(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values of a tree of depth two over the bins of one feature."""
    out = np.zeros(len(g))
    _, k = _cut(g, h, ridge, least)
    for a, b in [(0, len(g))] if k < 0 else [(0, k + 1), (k + 1, len(g))]:
        _, m = _cut(g[a:b], h[a:b], ridge, least)
        for c, d in [(a, b)] if m < 0 else [(a, a + m + 1), (a + m + 1, b)]:
            out[c:d] = -g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts rows of the grid, then each side's columns."""
    best, out = 0.0, np.zeros(g.shape)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for r in range(g.shape[0] - 1):
        gain, value = -whole, np.zeros(g.shape)
        for a, b in ((0, r + 1), (r + 1, g.shape[0])):
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            more, k = _cut(gs, hs, ridge, least)
            gain += more + gs.sum() ** 2 / (hs.sum() + ridge)
            for c, d in [(0, len(gs))] if k < 0 else [(0, k + 1), (k + 1, len(gs))]:
                value[a:b, c:d] = -gs[c:d].sum() / (hs[c:d].sum() + ridge)
        if gain > best:
            best, out = gain, value
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, *, bins: int = 48, grid: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.08, ridge: float = 2.0, least: float = 1.0) -> AdditiveModel:
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    width = x.shape[1]
    edges, coarse = ([edges_of(x[:, j], n) for j in range(width)] for n in (bins, grid))
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, tables, coarse, [], [])
    if not len(y) or y.min() == y.max():
        return model
    codes = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    cells = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]
    margin = np.full(len(y), model.intercept)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = rest()
            step = rate * _steps(np.bincount(codes[j], g, len(table)), np.bincount(codes[j], h, len(table)), ridge, least)
            table += step
            margin += step[codes[j]]

    def squares(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cells[i] * shape[1] + cells[j]
        g, h = rest()
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {(i, j): _quadrants(*squares(i, j)[1:], ridge, least)[0] for i in range(width) for j in range(i)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            at, g, h = squares(i, j)
            step = rate * _quadrants(g, h, ridge, least)[1]
            table += step
            margin += step.ravel()[at]
    return model


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels: doc_id, quality."""
    stats = stage(statistics(docs).select("doc_id", "features"), "statistics")
    model = fit_additive(*labelled_sample(stats, labels, max_rows))
    scored = stats.mapInPandas(score_batches(model, "score"), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
