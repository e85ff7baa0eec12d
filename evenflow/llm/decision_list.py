"""Quality rules: an ordered decision list learned by sequential covering.

A rule is a conjunction of thresholds on statistics of a text and covers texts of low quality. It is grown condition
by condition on two thirds of the remaining labelled rows (largest information gain), pruned on the other third
(trailing conditions go while that does not lower the rule's worth), and accepted when it is precise enough there. The rows
it covers are taken out and the next rule is learned. The list becomes one ordered Spark conditional expression:
the first rule that holds decides, a text that no rule covers is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenflow.llm.labelled import MAX_TRAIN, training_sample
from evenflow.llm.quality_gam import quantile_edges
from evenflow.llm.text_stats import FEATURES, ratios, with_statistics

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def expression(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.threshold if self.above else features[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), dtype=bool))


def _information(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(bad, 1e-9) / np.maximum(bad + good, 1e-9))


def grow(x: np.ndarray, bad: np.ndarray, longest: int, bins: int) -> Rule:
    """Add the condition with the largest gain until only low quality is covered, nothing is gained, or ``longest``."""
    rule: list[Condition] = []
    while len(rule) < longest and bad.any() and not bad.all():
        best, chosen = 1e-6, None
        before = _information(np.array(bad.sum()), np.array((~bad).sum()))
        for f, name in enumerate(FEATURES):
            edges = quantile_edges(x[:, f], bins)
            if not len(edges):
                continue
            code = np.searchsorted(edges, x[:, f], "left")  # x <= edges[code]
            low_bad = np.cumsum(np.bincount(code[bad], minlength=len(edges) + 1))[:-1]
            low_good = np.cumsum(np.bincount(code[~bad], minlength=len(edges) + 1))[:-1]
            for above, p, n in ((False, low_bad, low_good), (True, bad.sum() - low_bad, (~bad).sum() - low_good)):
                gain = p * (_information(p, n) - before)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, chosen = gain[i], Condition(name, above, float(edges[i]))
        if chosen is None:
            break
        rule.append(chosen)
        inside = chosen.holds(x)
        x, bad = x[inside], bad[inside]
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest head of the rule with the largest worth (p - n) / (p + n) on rows it was not grown on."""
    def worth(head: Rule) -> float:
        inside = covered(head, x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        return (p - n) / (p + n) if p + n else -1.0

    heads = [rule[:i] for i in range(1, len(rule) + 1)]
    return max(heads, key=lambda head: (worth(head), -len(head))) if heads else ()


def learn_rules(x: np.ndarray, y: np.ndarray, precision: float = 0.8, least: int = 5, longest: int = 4, most: int = 24, bins: int = 64) -> list[Rule]:
    """Rules for label 0 among 0/1 labels ``y``; fewer than ``least`` covered rows or a lower precision end the list."""
    rules: list[Rule] = []
    x, bad = x.copy(), y == 0
    while len(rules) < most and bad.sum() >= least:
        aside = np.arange(len(x)) % 3 == 2
        rule = prune(grow(x[~aside], bad[~aside], longest, bins), x[aside], bad[aside])
        inside, tested = covered(rule, x), covered(rule, x[aside])
        if not rule or (bad & inside).sum() < least or bad[inside].mean() < precision or (tested.any() and bad[aside][tested].mean() < precision):
            break
        rules.append(rule)
        x, bad = x[~inside], bad[~inside]
    return rules


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The list as one ordered conditional: false where a rule holds, else true."""
    out = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, (c.expression(features) for c in rule))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. kept: false if
    base_failed, else the verdict of ``rules`` (learned from at most ``max_train`` labelled documents if not given).
    Null and empty texts have no words and fail; repeated rows give repeated results; without usable labels there are
    no rules. Other columns are not read.
    """
    if rules is None:
        rules = learn_rules(*training_sample(docs, labels, max_rows=max_train))
    counts = F.col("__counts")
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    return with_statistics(docs.select("doc_id", "text")).select(
        "doc_id", *(counts[name].alias(name) for name in BASE), failed.alias("base_failed"), (~failed & verdict(rules, ratios())).alias("kept"))
