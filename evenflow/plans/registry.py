"""Named repair strategies. A strategy turns one chunk into a template; applications may register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from evenflow.operators.bounds import Bounds
from evenflow.plans.optimal import optimal_template
from evenflow.plans.pattern import naive_template, reversed_template
from evenflow.plans.swaps import greedy_swap, greedy_swaps, internal_swap


@dataclass(frozen=True)
class Strategy:
    """``by_counts`` strategies see only the category counts of a chunk, the others its label sequence.

    ``make(bounds, window)`` returns the function that maps counts or labels to a template.
    """

    name: str
    by_counts: bool
    make: Callable[[Bounds, int], Callable[[np.ndarray], np.ndarray]]
    needs_whole_blocks: bool = True
    #: The same for many chunks of one length at once: (chunks x labels) to (chunks x templates).
    make_many: Callable[[Bounds, int], Callable[[np.ndarray], np.ndarray]] | None = None


_STRATEGIES: dict[str, Strategy] = {}


def register_strategy(strategy: Strategy) -> None:
    _STRATEGIES[strategy.name] = strategy


def strategy(name: str) -> Strategy:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(_STRATEGIES)}")
    return _STRATEGIES[name]


def template_function(chosen: Strategy, bounds: Bounds, window: int) -> Callable[[np.ndarray], np.ndarray]:
    """labels -> template. Count-based plans are remembered: chunks with equal counts share one template.

    Takes the strategy and not its name: names are looked up on the driver, where applications register them.
    """
    plan = chosen.make(bounds, window)
    if not chosen.by_counts:
        return plan
    kinds = len(bounds.categories)
    remembered = lru_cache(maxsize=4096)(lambda counts: plan(np.array(counts)))
    return lambda labels: remembered(tuple(np.bincount(labels, minlength=kinds).tolist()))


def _visit_order(bounds: Bounds) -> np.ndarray:
    return np.array(sorted(range(len(bounds.categories)), key=lambda i: bounds.categories[i]))


def _arrays(bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(bounds.floor), np.array(bounds.ceiling), np.array(bounds.target)


def _optimal(bounds: Bounds, window: int):
    floor, ceiling, _ = _arrays(bounds)
    return lambda counts: optimal_template(counts, bounds.block, floor, ceiling)


def _naive(bounds: Bounds, window: int):
    return lambda counts: naive_template(counts, bounds.block, _arrays(bounds)[2])


def _reversed(bounds: Bounds, window: int):
    return lambda counts: reversed_template(counts, bounds.block, _arrays(bounds)[2])


def _internal(bounds: Bounds, window: int):
    target, visit = _arrays(bounds)[2], _visit_order(bounds)
    return lambda labels: internal_swap(labels, window, bounds.block, target, visit)


def _greedy(weighted: bool):
    def make(bounds: Bounds, window: int):
        target, visit = _arrays(bounds)[2], _visit_order(bounds)
        return lambda labels: greedy_swap(labels, window, bounds.block, target, visit, weighted)
    return make


def _greedy_many(weighted: bool):
    def make(bounds: Bounds, window: int):
        target, visit = _arrays(bounds)[2], _visit_order(bounds)
        return lambda chunks: greedy_swaps(chunks, window, bounds.block, target, visit, weighted)
    return make


def _identity(bounds: Bounds, window: int):
    return lambda labels: np.asarray(labels)


for _strategy in (
    Strategy("before", False, _identity, needs_whole_blocks=False),
    Strategy("optimal", True, _optimal, needs_whole_blocks=False),
    Strategy("naive", True, _naive),
    Strategy("naive_reversed", True, _reversed),
    Strategy("internal_swap", False, _internal),
    Strategy("greedy_swap", False, _greedy(False), make_many=_greedy_many(False)),
    Strategy("weighted_greedy_swap", False, _greedy(True), make_many=_greedy_many(True)),
):
    register_strategy(_strategy)
