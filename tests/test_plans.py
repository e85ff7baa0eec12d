"""Planners on small label words: hand-traced cases and exhaustive or property checks."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenflow.operators.bounds import Bounds
from evenflow.plans.labels import fair_blocks, fair_blocks_per_window, fifo_order
from evenflow.plans.optimal import extra_grid, longest_fair_length, optimal_template
from evenflow.plans.pattern import naive_template, repeats, reversed_template
from evenflow.plans import swaps
from evenflow.plans.swaps import greedy_swap, internal_swap


def word(template):
    return "".join("ABCDEF"[i] for i in template)


def idx(text):
    return np.array(["ABCDEF".index(c) for c in text.replace(" ", "")])


P = Bounds.from_proportions({"A": 0.3, "B": 0.3, "C": 0.4}, 3)


def test_exact_tiling():
    out = optimal_template([2, 3, 4], 3, P.floor, P.ceiling)
    assert sorted(word(out)) == sorted("AABBBCCCC")
    assert fair_blocks(out, 3, np.array(P.floor), np.array(P.ceiling)).sum() == 7


def test_leftover_region():
    counts = np.array([2, 5, 5])
    out = optimal_template(counts, 3, P.floor, P.ceiling)
    assert longest_fair_length(counts, 3, np.array(P.floor), np.array(P.ceiling)) == 11
    assert sorted(word(out)) == sorted("AABBBBBCCCCC")
    assert fair_blocks(out, 3, np.array(P.floor), np.array(P.ceiling)).sum() == 9


def test_wrapped_extras_never_meet():
    grid = extra_grid(np.array([4, 3, 0, 1, 4, 4]), 4, 4)
    assert sorted(grid.ravel().tolist()) == [0] * 4 + [1] * 3 + [3] + [4] * 4 + [5] * 4
    for above, below in zip(grid, grid[1:], strict=False):
        for c in set(above.tolist()) & set(below.tolist()):
            assert above.tolist().index(c) == below.tolist().index(c)


def brute_length(counts, block, floor, ceiling):
    """Longest all-fair word over these counts, by depth-first search."""
    best, stack = 0, [()]
    seen = set()
    while stack:
        w = stack.pop()
        used = np.bincount(np.array(w, dtype=int), minlength=len(counts))
        if len(w) >= block:
            best = max(best, len(w))
        state = (tuple(used), w[-(block - 1):])
        if state in seen:
            continue
        seen.add(state)
        for c in range(len(counts)):
            if used[c] < counts[c]:
                after = np.bincount(np.array([*w[len(w) - block + 1:], c] if len(w) >= block - 1 else [*w, c]), minlength=len(counts))
                if (after <= ceiling).all() and (len(w) + 1 < block or (after >= floor).all()):
                    stack.append((*w, c))
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=4, max_size=4), st.lists(st.integers(1, 5), min_size=4, max_size=4), st.sampled_from([3, 4, 5]))
def test_no_longer_stretch_exists(counts, weights, block):
    bounds = Bounds.from_counts(dict(zip("ABCD", weights, strict=True)), block)
    floor, ceiling = np.array(bounds.floor), np.array(bounds.ceiling)
    counts = np.array(counts)
    assert longest_fair_length(counts, block, floor, ceiling) == brute_length(counts, block, floor, ceiling)


def test_pattern_strategies():
    counts, target = np.array([5, 6, 9]), np.array([2, 1, 2])
    assert repeats(counts, target)[0] == 2
    assert word(naive_template(counts, 5, target)) == "BCCAABCCAABCCABBCCBC"
    assert word(reversed_template(counts, 5, target)) == "CCCBBBBACCABACCABACC"


def test_pattern_without_leftovers_and_with_zero_target():
    assert word(naive_template([4, 2], 3, np.array([2, 1]))) == "AABAAB"
    assert word(reversed_template([4, 2], 3, np.array([2, 1]))) == "AABAAB"
    out = naive_template([4, 1, 1], 3, np.array([2, 1, 0]))
    assert sorted(word(out)) == sorted("AAAABC")
    with pytest.raises(ValueError):
        naive_template([2, 2], 3, np.array([2, 1]))


def test_swaps():
    one, visit = np.array([1, 1]), np.arange(2)
    assert word(internal_swap(idx("AAABAB"), 6, 2, one, visit)) == "BABAAA"
    for weighted in (False, True):
        assert word(greedy_swap(idx("AAABBB"), 4, 2, one, visit, weighted)) == "BABABA"


def test_apportionment():
    assert Bounds.from_proportions({"a": 0.5, "b": 0.3, "c": 0.2}, 7).target == (4, 2, 1)
    assert Bounds.from_proportions(dict.fromkeys("abcd", 0.25), 6).target == (2, 2, 1, 1)
    exact = Bounds.from_counts({"a": 7, "b": 93}, 100)
    assert exact.floor == exact.ceiling == exact.target == (7, 93)


def test_window_counts():
    counts = fair_blocks_per_window(idx("ABABBBAA"), 4, 2, np.array([1, 1]), np.array([1, 1]))
    assert counts.tolist() == [2, 1, 1, 1, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=6, max_size=9), st.sampled_from([2, 3]))
def test_optimal_matches_exhaustive_search(labels, block):
    labels = np.array(labels[: len(labels) // block * block])
    weights = np.bincount(labels, minlength=3) + 1
    bounds = Bounds.from_counts(dict(zip("ABC", weights.tolist(), strict=True)), block)
    floor, ceiling = np.array(bounds.floor), np.array(bounds.ceiling)
    counts = np.bincount(labels, minlength=3)
    best = max(fair_blocks(np.array(p), block, floor, ceiling).sum() for p in set(permutations(labels.tolist())))
    out = optimal_template(counts, block, floor, ceiling)
    length = longest_fair_length(counts, block, floor, ceiling)
    assert np.bincount(out, minlength=3).tolist() == counts.tolist()
    assert fair_blocks(out, block, floor, ceiling).sum() == best == max(0, length - block + 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=20, max_size=60), st.lists(st.integers(1, 9), min_size=5, max_size=5),
       st.sampled_from([5, 6, 10]))
def test_region_is_all_fair_for_any_length(labels, weights, block):
    bounds = Bounds.from_counts(dict(zip("ABCDE", weights, strict=True)), block)
    floor, ceiling = np.array(bounds.floor), np.array(bounds.ceiling)
    counts = np.bincount(labels, minlength=5)
    out = optimal_template(counts, block, floor, ceiling)
    length = longest_fair_length(counts, block, floor, ceiling)
    assert np.bincount(out, minlength=5).tolist() == counts.tolist()
    if length >= block:
        assert fair_blocks(out[:length], block, floor, ceiling).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=18, max_size=18), st.sampled_from([(12, 3), (12, 6), (18, 3)]))
def test_swaps_permute_and_keep_the_landmark_rules(labels, sizes):
    window, block = sizes
    target = np.array(Bounds.from_proportions({"A": 0.4, "B": 0.4, "C": 0.2}, block).target)
    visit, before = np.arange(3), np.array(labels)
    inner = internal_swap(before, window, block, target, visit)
    assert np.bincount(inner[:window], minlength=3).tolist() == np.bincount(before[:window], minlength=3).tolist()
    assert inner[window:].tolist() == before[window:].tolist()
    for weighted in (False, True):
        out = greedy_swap(before, window, block, target, visit, weighted)
        assert sorted(out) == sorted(labels)
    order = fifo_order(before, out)
    assert before[order].tolist() == out.tolist()
    for c in range(3):
        assert (np.diff(order[out == c]) > 0).all()


@given(st.integers(2, 6), st.integers(1, 5), st.integers(1, 20), st.booleans(), st.randoms(use_true_random=False))
def test_kept_slot_scores_follow_the_definition(block, blocks, landmark, weighted, random):
    """Every slot's score is the sum, over all shifts of the grid, of the shortage of the block around it."""
    window = block * blocks
    missing = np.array([random.randint(0, 3) for _ in range(window - block + 1)])
    own, grids = swaps._start_weights(len(missing), block, landmark, weighted)
    got = swaps._slot_scores(missing, np.arange(window), block, own, grids)

    def brute(slot):
        starts = [(h, h + max((slot - h) // block, 0) * block) for h in range(landmark + 1)]
        return sum((landmark - h if weighted else 1) * missing[s] for h, s in starts if s < len(missing))

    want = np.array([brute(slot) for slot in range(window)])
    assert (got - want == got[0] - want[0]).all()
