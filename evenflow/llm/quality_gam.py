"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into quantile bins. Boosting goes round the features in turn; each step fits a tree of depth two to
the gradients of one feature's bins and adds it, shrunk, to that feature's lookup table. When the single features are
done, the pairs with the largest remaining gain get tables of their own in the same way. A score is the logistic
function of an intercept plus one table entry per feature and pair. Fitting uses a bounded labelled sample on the
driver; scoring counts the texts of a whole batch and adds the table entries of its binned rows, inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evenflow.llm.labelled import MAX_TRAIN, held_out, training_sample
from evenflow.llm.store import free_names
from evenflow.llm.text_stats import feature_rows

RIDGE, LEAST_WEIGHT = 1.0, 2.0


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins, halfway between neighbouring values near the quantiles."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins)))
    return (values[1:] + values[:-1]) / 2


def _gain(g, h):
    return np.where(h >= LEAST_WEIGHT, g * g / (h + RIDGE), -np.inf)


def _value(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting a run of bins in two, and where; no gain: (0, 0)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - g.sum() ** 2 / (h.sum() + RIDGE)
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 1e-9 else (0.0, 0)


def bin_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient sums ``g`` and weights ``h``."""
    _, cut = _split(g, h) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), _value(g.sum(), h.sum()))
    return np.concatenate([bin_tree(g[:cut], h[:cut], depth - 1), bin_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts a grid first along one axis, then each half along the other."""
    best, out = -np.inf, np.full(g.shape, _value(g.sum(), h.sum()))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            parts, gain = [], 0.0
            for half in (slice(None, cut), slice(cut, None)):
                gg, hh = a[half].sum(axis=0), b[half].sum(axis=0)
                own, at = _split(gg, hh)
                gain += own + gg.sum() ** 2 / (hh.sum() + RIDGE)
                parts.append((half, at, gg, hh))
            if gain > best:
                best, grid = gain, np.empty(a.shape)
                for half, at, gg, hh in parts:
                    grid[half, :at] = _value(gg[:at].sum(), hh[:at].sum())
                    grid[half, at:] = _value(gg[at:].sum(), hh[at:].sum())
                out = grid.T if turned else grid
    return best - g.sum() ** 2 / (h.sum() + RIDGE), out


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 48, pairs: int = 6, pair_rounds: int = 40,
    pair_bins: int = 10,
) -> AdditiveModel:
    """Fit on 0/1 labels. Without rows, or with one class only, the model is a constant near the share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    edges, coarse = [quantile_edges(x[:, f], bins) for f in range(width)], [quantile_edges(x[:, f], pair_bins) for f in range(width)]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))), [], coarse)
    if len(y) == 0 or y.min() == y.max():
        return model
    code = [np.searchsorted(edges[f], x[:, f], "right") for f in range(width)]
    rough = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(width)]
    logit = np.full(len(y), model.intercept)

    def gradients():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            residual, weight = gradients()
            size = len(model.tables[f])
            step = rate * bin_tree(np.bincount(code[f], residual, size), np.bincount(code[f], weight, size))
            model.tables[f] += step
            logit += step[code[f]]

    def grid(i, j):
        residual, weight = gradients()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell, size = rough[i] * shape[1] + rough[j], shape[0] * shape[1]
        return np.bincount(cell, residual, size).reshape(shape), np.bincount(cell, weight, size).reshape(shape)

    ranked = sorted(((pair_tree(*grid(i, j))[0], i, j) for i, j in combinations(range(width), 2)), key=lambda t: (-t[0], t[1:]))
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = rate * pair_tree(*grid(i, j))[1]
            tables[i, j] += step
            logit += step[rough[i], rough[j]]
    model.pairs = [(i, j, table) for (i, j), table in tables.items()]
    return model


def _scorer(model: AdditiveModel):
    @F.arrow_udf(DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(feature_rows(column)))
    return score


def with_quality(docs: DataFrame, model: AdditiveModel, into: str) -> DataFrame:
    """``docs`` with the score of every row's text; other columns are kept and not read.

    Texts are counted and scored in one step: with two, every task would keep two Python workers.
    """
    return docs.withColumn(into, _scorer(model)(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 5, part: int = 0,
                   max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learned from at most ``max_train`` labelled documents outside the held-out part. Null and empty texts are scored
    as texts without words; repeated rows give repeated results; without usable labels every score is 0.5.
    """
    out = held_out(F.col("doc_id"), parts, part)
    model = fit_additive(*training_sample(docs.where(~out), labels, max_rows=max_train))
    return with_quality(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` whose quality score reaches ``threshold``; columns stay as they are."""
    model = fit_additive(*training_sample(docs, labels, max_rows=max_train))
    score, = free_names(docs, "score")
    return with_quality(docs, model, score).where(F.col(score) >= threshold).select(*docs.columns)
