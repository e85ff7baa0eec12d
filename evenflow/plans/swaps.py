"""Swap heuristics: baselines that exchange single labels inside a window or with its landmark.

All three judge blocks by the target as a minimum. Donor blocks are deliberately not re-checked after they
gave something away.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _shortage(labels: np.ndarray, block: int, target: np.ndarray) -> np.ndarray:
    """(blocks x categories) missing labels of the aligned blocks."""
    blocks, kinds = len(labels) // block, len(target)
    cells = np.repeat(np.arange(blocks) * kinds, block) + labels[: blocks * block]
    return np.maximum(target - np.bincount(cells, minlength=blocks * kinds).reshape(blocks, kinds), 0)


def internal_swap(labels: np.ndarray, window: int, block: int, target: np.ndarray, visit: np.ndarray) -> np.ndarray:
    """Repair each unfair block from the first later fair block; the last block and the landmark stay put."""
    labels, target = np.array(labels, dtype=np.int64), np.asarray(target)
    inside = labels[:window]                   # a view: swaps write through
    last = window // block - 1
    for here in range(last):
        for _ in range(window):                # every pass uses up a fair donor, so this bound is never met
            short = _shortage(inside, block, target)
            if not short[here].any():
                break
            moved = 0
            for cat in visit[short[here][visit] > 0]:
                moved += _borrow(inside, here, cat, int(short[here, cat]), block, target)
            if not moved:
                return labels
    return labels


def _borrow(inside: np.ndarray, here: int, cat: int, need: int, block: int, target: np.ndarray) -> int:
    fair_later = np.flatnonzero(~_shortage(inside, block, target)[here + 1:].any(axis=1))
    if not len(fair_later):
        return 0
    donor = (here + 1 + int(fair_later[0])) * block
    takers = here * block + np.flatnonzero(inside[here * block:(here + 1) * block] != cat)
    givers = donor + np.flatnonzero(inside[donor:donor + block] == cat)[::-1]
    pairs = min(need, len(takers), len(givers))
    takers, givers = takers[:pairs], givers[:pairs]
    inside[takers], inside[givers] = inside[givers], inside[takers]
    return pairs


def greedy_swap(labels: np.ndarray, window: int, block: int, target: np.ndarray, visit: np.ndarray,
                weighted: bool = False) -> np.ndarray:
    """Internal swaps, then one landmark label per step into the first unfair block, best-scored slot first.

    A slot scores the shortages of the blocks around it under every shift of the block grid. The counts of all
    possible blocks are kept for every category; a swap changes only the blocks that hold its slot.
    """
    target = np.asarray(target)
    labels = internal_swap(labels, window, block, target, visit)
    inside, landmark = labels[:window], labels[window:]
    if not len(landmark):
        return labels
    held = _block_counts(inside, block, len(target))
    own, grids = _start_weights(window - block + 1, block, len(landmark), weighted)
    stock = np.bincount(landmark, minlength=len(target))
    for _ in range(len(landmark) + 1):
        short = target[:, None] > held[:, ::block]
        unfair = np.flatnonzero(short.any(axis=0))
        if not len(unfair):
            break
        wanted = visit[short[visit, unfair[0]] & (stock[visit] > 0)]
        if not len(wanted):
            break
        cat, start = wanted[0], int(unfair[0]) * block
        slots = start + np.flatnonzero(inside[start:start + block] != cat)
        near = slice(max(0, start - block + 1), start + block)
        missing = np.maximum(target[cat] - held[cat, near], 0)
        slot = slots[np.argmax(_slot_scores(missing, slots - near.start, block, own[near], grids[near]))]
        giver = np.flatnonzero(landmark == cat)[-1]
        gone = inside[slot]
        stock[cat] -= 1
        stock[gone] += 1
        touched = slice(max(0, slot - block + 1), slot + 1)
        held[cat, touched] += 1
        held[gone, touched] -= 1
        inside[slot], landmark[giver] = cat, gone
    return labels


def _block_counts(labels: np.ndarray, block: int, kinds: int) -> np.ndarray:
    """(categories x starts) counts of the block that begins at each place."""
    seen = np.zeros((kinds, len(labels) + 1), dtype=np.int64)
    np.cumsum(labels == np.arange(kinds)[:, None], axis=1, out=seen[:, 1:])
    return seen[:, block:] - seen[:, :-block]


@lru_cache(maxsize=16)
def _start_weights(starts: int, block: int, landmark: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per block start: the weight of the shift that begins there, and of all shifts whose grid has a block there."""
    shifts = np.arange(starts)
    own = np.where(shifts <= landmark, landmark - shifts if weighted else 1, 0)
    grids = np.pad(own, (0, -starts % block)).reshape(-1, block).cumsum(axis=0).ravel()[:starts]
    return own, grids


def _slot_scores(missing: np.ndarray, slots: np.ndarray, block: int, own: np.ndarray, grids: np.ndarray) -> np.ndarray:
    """Weighted shortage around each slot, up to a constant.

    Blocks that hold the slot count, and so does the first block of every grid that begins after it; the latter are
    all later ones less those up to the slot.
    """
    holding, begun = np.zeros((2, len(missing) + 1), dtype=np.int64)
    np.cumsum(missing * grids, out=holding[1:])
    np.cumsum(missing * own, out=begun[1:])
    ends = np.minimum(slots + 1, len(missing))
    return holding[ends] - holding[np.maximum(slots - block + 1, 0)] - begun[ends]


#: Block counts that are held at once while many chunks are swapped together.
MOST_COUNTS = 1 << 22


def greedy_swaps(chunks: np.ndarray, window: int, block: int, target: np.ndarray, visit: np.ndarray,
                 weighted: bool = False) -> np.ndarray:
    """``greedy_swap`` of every row of ``chunks``: all of them take their next step together."""
    target = np.asarray(target)
    out = np.empty(chunks.shape, dtype=np.int64)
    some = max(1, MOST_COUNTS // (len(target) * (window - block + 1)))
    for begin in range(0, len(chunks), some):
        part = [internal_swap(labels, window, block, target, visit) for labels in chunks[begin:begin + some]]
        out[begin:begin + some] = _greedy_together(np.stack(part), window, block, target, visit, weighted)
    return out


def _greedy_together(labels: np.ndarray, window: int, block: int, target: np.ndarray, visit: np.ndarray, weighted: bool) -> np.ndarray:
    inside, landmark = labels[:, :window], labels[:, window:]  # views: swaps write through
    reach, kinds, starts = landmark.shape[1], len(target), window - block + 1
    if not reach:
        return labels
    seen = np.zeros((len(labels), kinds, window + 1), dtype=np.int64)
    np.cumsum(inside[:, None, :] == np.arange(kinds)[:, None], axis=2, out=seen[:, :, 1:])
    held = seen[:, :, block:] - seen[:, :, :-block]
    own, grids = _start_weights(starts, block, reach, weighted)
    stock = (landmark[:, None, :] == np.arange(kinds)[:, None]).sum(axis=2)
    at, offsets, places = np.arange(len(labels)), np.arange(1 - block, block), np.arange(block)
    for _ in range(reach + 1):
        short = target[:, None] > held[at][:, :, ::block]
        unfair = short.any(axis=1)
        first = unfair.argmax(axis=1)
        wanted = short[np.arange(len(at)), :, first][:, visit] & (stock[at][:, visit] > 0)
        going = unfair.any(axis=1) & wanted.any(axis=1)
        at, first, wanted = at[going], first[going], wanted[going]
        if not len(at):
            break
        cat, start = visit[wanted.argmax(axis=1)], first * block
        # Blocks around the first unfair one, those beyond the window count nothing.
        near = start[:, None] + offsets
        real = (near >= 0) & (near < starts)
        near = np.where(real, near, 0)
        missing = np.where(real, np.maximum(target[cat][:, None] - held[at[:, None], cat[:, None], near], 0), 0)
        holding, begun = np.zeros((2, len(at), 2 * block), dtype=np.int64)
        np.cumsum(missing * grids[near], axis=1, out=holding[:, 1:])
        np.cumsum(missing * own[near], axis=1, out=begun[:, 1:])
        scores = holding[:, block:] - holding[:, :block] - begun[:, block:]
        free = inside[at[:, None], start[:, None] + places] != cat[:, None]
        slot = start + np.where(free, scores, np.iinfo(np.int64).min).argmax(axis=1)
        giver = reach - 1 - (landmark[at] == cat[:, None])[:, ::-1].argmax(axis=1)
        gone = inside[at, slot]
        stock[at, cat] -= 1
        stock[at, gone] += 1
        touched = slot[:, None] + np.arange(1 - block, 1)
        row, _ = (there := (touched >= 0) & (touched < starts)).nonzero()
        held[at[row], cat[row], touched[there]] += 1
        held[at[row], gone[row], touched[there]] -= 1
        inside[at, slot], landmark[at, giver] = cat, gone
    return labels
