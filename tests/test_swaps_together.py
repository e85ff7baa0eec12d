"""Chunks that are swapped and scored together give what each gives alone."""

from __future__ import annotations

import numpy as np
import pytest

from evenflow.plans import swaps
from evenflow.plans.labels import fair_blocks_of_chunks, fair_blocks_per_window


@pytest.mark.parametrize(("window", "block", "landmark", "kinds"), [(20, 10, 10, 5), (40, 20, 20, 3), (12, 4, 8, 2), (10, 10, 5, 4), (6, 3, 0, 3), (200, 50, 100, 7)])
@pytest.mark.parametrize("weighted", [False, True])
def test_greedy_swaps(monkeypatch, window, block, landmark, kinds, weighted):
    rng = np.random.default_rng(window + kinds)
    monkeypatch.setattr(swaps, "MOST_COUNTS", 5000)  # several parts
    shares = rng.dirichlet(np.ones(kinds))
    chunks = rng.choice(kinds, p=shares, size=(60, window + landmark))
    target = rng.multinomial(block, np.ones(kinds) / kinds)
    visit = rng.permutation(kinds)
    kept = chunks.copy()
    got = swaps.greedy_swaps(chunks, window, block, target, visit, weighted)
    assert (chunks == kept).all()
    assert (got == np.stack([swaps.greedy_swap(c, window, block, target, visit, weighted) for c in chunks])).all()
    floor, ceiling = np.maximum(target - 1, 0), target + 1
    want = [fair_blocks_per_window(c, window, block, floor, ceiling) for c in got]
    assert (fair_blocks_of_chunks(got, window, block, floor, ceiling) == np.stack(want)).all()
