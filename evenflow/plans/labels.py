"""Count-level vocabulary of the repair planners.

A planner never sees rows. It gets how often each category occurs in one chunk (or, for the swap heuristics,
the chunk's label sequence) and answers with a *template*: the category index wanted at every place. Spark
re-attaches whole rows to a template by stable first-in-first-out order inside each category.
"""

from __future__ import annotations

import numpy as np


def pour(amount: int, room: np.ndarray) -> np.ndarray:
    """Fill ``room`` from the left with ``amount`` units."""
    room = np.maximum(room, 0)
    return np.maximum(np.minimum(amount - (room.cumsum() - room), room), 0)


def rank_desc(score: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Indices ``among`` by descending score, ties to the earlier index."""
    return among[np.argsort(-score[among], kind="stable")]


def fifo_order(labels: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Row order that realises ``template``: its k-th c takes the k-th row labelled c."""
    order = np.empty(len(labels), dtype=np.int64)
    order[np.argsort(template, kind="stable")] = np.argsort(labels, kind="stable")
    return order


def fair_blocks(labels: np.ndarray, block: int, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """Verdict for every block of ``block`` consecutive labels."""
    seen = np.zeros((len(labels) + 1, len(floor)), dtype=np.int64)
    np.cumsum(labels[:, None] == np.arange(len(floor)), axis=0, out=seen[1:])
    counts = seen[block:] - seen[: max(0, len(seen) - block)]
    return ((counts >= floor) & (counts <= ceiling)).all(axis=1)


def fair_blocks_per_window(labels: np.ndarray, window: int, block: int, floor: np.ndarray,
                           ceiling: np.ndarray) -> np.ndarray:
    """Fair aligned blocks of every window of ``window`` consecutive labels; none if there are fewer."""
    verdict = fair_blocks(labels, block, floor, ceiling)
    starts = max(0, len(labels) - window + 1)
    return sum(verdict[lag:lag + starts].astype(np.int64) for lag in range(0, window, block))


def fair_blocks_of_chunks(chunks: np.ndarray, window: int, block: int, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """``fair_blocks_per_window`` of every row of ``chunks``."""
    fair, starts = True, max(0, chunks.shape[1] - window + 1)
    for kind, (low, high) in enumerate(zip(floor, ceiling, strict=True)):
        seen = np.zeros((len(chunks), chunks.shape[1] + 1), dtype=np.int64)
        np.cumsum(chunks == kind, axis=1, out=seen[:, 1:])
        counts = seen[:, block:] - seen[:, : max(0, seen.shape[1] - block)]
        fair = fair & (counts >= low) & (counts <= high)
    return sum(fair[:, lag:lag + starts].astype(np.int64) for lag in range(0, window, block))
