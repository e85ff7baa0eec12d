"""Windowed repair of one stream, fed piece by piece.

The window slides by one row. When it is unfair and X more rows are there, the W+X rows are reordered in
place and the window moves on behind the repaired prefix; the carried suffix takes part in later windows.
The same object serves batch partitions and streaming state: feed rows in order, take what is settled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from evenflow.plans.labels import fair_blocks_per_window, fifo_order


@dataclass
class Edit:
    """One repair: row ids and labels of the chunk as it was, and the order they were put in."""

    number: int
    before: np.ndarray
    labels: np.ndarray
    order: np.ndarray


@dataclass
class Episode:
    window: int
    landmark: int
    block: int
    floor: np.ndarray
    ceiling: np.ndarray
    template: Callable[[np.ndarray], np.ndarray]
    max_windows: int | None = None
    until: int | None = None  # first window start, from the stream's begin, that is another run's business
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    start: int = 0            # first window start that is not decided yet, relative to ``rows``
    settled: int = 0          # rows already handed out
    windows: int = 0          # windows covered: one per check, X per repair
    fair_checks: int = 0
    edits: int = 0

    @property
    def stopped(self) -> bool:
        if self.until is not None and self.settled + self.start >= self.until:
            return True
        return self.max_windows is not None and self.windows >= self.max_windows

    def feed(self, rows: np.ndarray, labels: np.ndarray) -> list[Edit]:
        """Append rows and run every check that is now possible."""
        if self.stopped:
            return []
        self.rows = np.concatenate([self.rows, rows])
        self.labels = np.concatenate([self.labels, labels])
        done, reach = [], max(64, self.landmark)
        while not self.stopped:
            end = min(len(self.rows), self.start + self.window + reach)
            checks = end - self.window - self.start + 1
            if checks < 1:
                break
            fair = self._fair(self.start, end)
            if self.max_windows is not None:
                fair = fair[: self.max_windows - self.windows]
            if self.until is not None:
                fair = fair[: self.until - self.settled - self.start]
            ahead = len(fair) if fair.all() else int(np.argmin(fair))
            self.start += ahead
            self.windows += ahead
            self.fair_checks += ahead
            if ahead == len(fair):
                reach = min(reach * 2, 1 << 16)
                continue
            if self.start + self.window + self.landmark > len(self.rows):
                break  # unfair, but the landmark is not complete yet
            done.append(self._repair())
            reach = max(64, self.landmark)
        return done

    def take(self) -> np.ndarray:
        """Row ids that left the window for good, in their final order."""
        keep = min(self.start, max(0, len(self.rows) - self.window))
        out, self.rows, self.labels = self.rows[:keep], self.rows[keep:], self.labels[keep:]
        self.start -= keep
        self.settled += keep
        return out

    def finish(self) -> np.ndarray:
        """End of the stream: what is left goes out in its current order, an incomplete landmark unedited."""
        out, self.rows, self.labels = self.rows, self.rows[:0], self.labels[:0]
        self.settled += len(out)
        self.start = 0
        return out

    def carried(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(next window start, rows, labels) from the stream's begin: all that later checks know of earlier repairs.

        Rows are named by their place in the stream; those at their own place up to the end are left out.
        """
        at, rows = self.settled + self.start, self.rows[self.start:]
        moved = np.flatnonzero(rows != np.arange(at, at + len(rows)))
        keep = int(moved[-1]) + 1 if len(moved) else 0
        return at, rows[:keep], self.labels[self.start:self.start + keep]

    def _fair(self, begin: int, end: int) -> np.ndarray:
        counts = fair_blocks_per_window(self.labels[begin:end], self.window, self.block, self.floor, self.ceiling)
        return counts == self.window // self.block

    def _repair(self) -> Edit:
        chunk = slice(self.start, self.start + self.window + self.landmark)
        before, labels = self.rows[chunk].copy(), self.labels[chunk].copy()
        order = fifo_order(labels, self.template(labels))
        self.rows[chunk], self.labels[chunk] = before[order], labels[order]
        edit = Edit(self.edits, before, labels, order)
        self.edits += 1
        self.windows += 1 + self.landmark
        self.start += self.landmark + 1
        return edit
