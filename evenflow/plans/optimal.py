"""Optimal template: as many fair sliding blocks as the category counts allow.

An all-fair stretch is a grid of ``rows`` whole blocks and a shorter tail, ``s`` columns wide. Bounds leave every
category at most one item of choice per block, so a block holds its floor items and ``extra = s - sum(floor)`` further
items of distinct categories. If floor items keep their columns, and a category that is an extra of two neighbouring
rows keeps its column there, every sliding block is fair, whatever the extras are.

How long can the stretch be? ``rows`` is possible if the counts cover the floors and enough extras. A row is longer
than any tail, so the most rows win. What the rows leave decides the tail: floor items that are left, plus one item
each of up to ``extra`` categories with more than their floor left. An item given to the rows costs the tail nothing
while its category keeps more than floor + 1, at most one place after that; counting what can be given for free tells
the tail's length without trying anything.

Where do the extras go? By the wrap-around rule: extra columns are filled one after the other from the top row to the
bottom, category after category, those of every row first. A category then sits in one column, or at the bottom of one
and the top of the next with at least a row between, so no two neighbouring rows hold it in different columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from evenflow.plans.labels import pour


@dataclass(frozen=True)
class Stretch:
    """The longest all-fair stretch: extras of each category in the rows, floor items and extras in the tail."""

    rows: int
    extras: np.ndarray
    tail_floor: np.ndarray
    tail_extras: np.ndarray

    @property
    def tail(self) -> int:
        return int(self.tail_floor.sum()) + len(self.tail_extras)


def check_bounds(floor: np.ndarray, ceiling: np.ndarray, block: int) -> None:
    spread = ceiling - floor
    if (spread < 0).any() or (spread > 1).any() or not floor.sum() <= block <= ceiling.sum():
        raise ValueError("the optimal strategy needs floor <= ceiling <= floor + 1 around the block size")


def most_rows(counts: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> int:
    """Whole blocks that the counts cover; fewer are always possible too, so halving finds the most."""
    def possible(rows: int) -> bool:
        spare = counts - rows * floor
        choice = np.minimum(spare, rows)[ceiling > floor].sum()
        return bool((spare >= 0).all() and choice >= rows * (block - int(floor.sum())))

    low, high = 0, int(counts.sum()) // block
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if possible(middle) else (low, middle - 1)
    return low


def longest_stretch(counts: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> Stretch | None:
    """None if not even one block is possible."""
    rows, per_row = most_rows(counts, block, floor, ceiling), block - int(floor.sum())
    if not rows:
        return None
    loose, spare = ceiling > floor, counts - rows * floor
    room = np.where(loose, np.minimum(spare, rows), 0)
    # What the rows may take: items no tail misses, then a category's last item above its floor, then floor items.
    free = np.minimum(room, np.maximum(spare - floor - 1, 0))
    owed = rows * per_row
    taken = pour(owed, free)
    last = pour(owed - int(taken.sum()), np.where(spare > floor, np.minimum(room - free, 1), 0))
    taken = taken + last
    taken = taken + pour(owed - int(taken.sum()), room - taken)
    left = spare - taken
    above = np.flatnonzero(loose & (left > floor))[:per_row]
    base = np.minimum(left, floor)
    excess = int(base.sum()) + len(above) - (block - 1)
    if excess > 0:  # a tail is shorter than a block
        dropped = min(excess, len(above))
        above = above[: len(above) - dropped]
        base = base - pour(excess - dropped, base)
    return Stretch(rows, taken, base, above)


def longest_fair_length(counts: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> int:
    """Length of the longest all-fair arrangement of a part of these counts."""
    found = longest_stretch(counts, block, floor, ceiling)
    return found.rows * block + found.tail if found else 0


def extra_grid(extras: np.ndarray, rows: int, per_row: int) -> np.ndarray:
    """Category of every (row, extra column) by the wrap-around rule."""
    order = np.argsort(extras < rows, kind="stable")  # whole columns first, so they never wrap
    return np.repeat(order, extras[order]).reshape(per_row, rows).T


def optimal_template(counts: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """Template of a whole chunk: the fair stretch, then what is left, category by category."""
    counts, floor, ceiling = (np.asarray(v, dtype=np.int64) for v in (counts, floor, ceiling))
    check_bounds(floor, ceiling, block)
    kinds = np.arange(len(counts))
    found = longest_stretch(counts, block, floor, ceiling)
    if found is None:
        return np.repeat(kinds, counts)
    grid = extra_grid(found.extras, found.rows, block - int(floor.sum()))
    # The tail goes on under the bottom row: its extras stay in their columns there, new ones take idle columns.
    bottom = grid[-1].tolist() if grid.size else []
    new = iter([c for c in found.tail_extras.tolist() if c not in bottom])
    below = [c if c in found.tail_extras else next(new, None) for c in bottom]
    live = [i for i, c in enumerate(below) if c is not None]
    idle = [i for i, c in enumerate(below) if c is None]
    early, late = np.repeat(kinds, found.tail_floor), np.repeat(kinds, floor - found.tail_floor)
    row = [np.broadcast_to(early, (found.rows, len(early))), grid[:, live], grid[:, idle], np.broadcast_to(late, (found.rows, len(late)))]
    fair = np.concatenate([np.concatenate(row, axis=1).ravel(), early, np.array([below[i] for i in live], dtype=np.int64)])
    return np.concatenate([fair, np.repeat(kinds, counts - np.bincount(fair, minlength=len(counts)))])
