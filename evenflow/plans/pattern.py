"""Repeated-pattern templates: as many copies of the target pattern as the counts allow, then the rest."""

from __future__ import annotations

import numpy as np

from evenflow.plans.labels import rank_desc


def repeats(counts: np.ndarray, target: np.ndarray) -> tuple[int, np.ndarray]:
    """(copies of the target pattern that the counts hold, what remains); a zero target never limits."""
    needed = target > 0
    copies = int((counts[needed] // target[needed]).min()) if needed.any() else 0
    return copies, counts - copies * target


def naive_template(counts: np.ndarray, block: int, target: np.ndarray) -> np.ndarray:
    """Pattern copies first, leftover blocks after them; the pattern follows the first leftover block's order."""
    counts, target = np.asarray(counts, dtype=np.int64), np.asarray(target, dtype=np.int64)
    if counts.sum() % block:
        raise ValueError("the naive strategies need a chunk length that the block size divides")
    copies, rest = repeats(counts, target)
    leftovers = list(_leftover_blocks(rest.copy(), block, target))
    kinds = np.arange(len(counts))
    first = leftovers[0] if leftovers else np.empty(0, dtype=np.int64)
    seen = first[np.sort(np.unique(first, return_index=True)[1])]
    pattern = np.concatenate([seen, kinds[~np.isin(kinds, seen)]]).astype(np.int64)
    return np.concatenate([np.tile(np.repeat(pattern, target[pattern]), copies), *leftovers])


def _leftover_blocks(rest: np.ndarray, block: int, target: np.ndarray):
    kinds = np.arange(len(rest))
    while rest.any():
        parts, room, share = [], block, target
        while room:
            for c in rank_desc(rest - target, kinds[rest > 0]):
                take = min(int(share[c]), room, int(rest[c]))
                parts.append(np.full(take, c))
                rest[c] -= take
                room -= take
            share = np.where(target > 0, target, block)  # top-up rounds: a zero target may use all the room
        yield np.concatenate(parts)


def reversed_template(counts: np.ndarray, block: int, target: np.ndarray) -> np.ndarray:
    """Variant whose pattern starts with the leftover prefix, emitted back to front."""
    counts, target = np.asarray(counts, dtype=np.int64), np.asarray(target, dtype=np.int64)
    copies, rest = repeats(counts, target)
    kinds = np.arange(len(counts))
    if not rest.any():
        return np.tile(np.repeat(kinds, target), copies)
    size = np.minimum(target, rest)
    by_size = rank_desc(size, kinds)
    prefix = np.repeat(by_size, size[by_size])
    missing = np.repeat(by_size, (target - size)[by_size])
    pattern = np.concatenate([prefix, missing])
    return np.concatenate([np.tile(pattern, copies), prefix, np.repeat(kinds, rest - size)])[::-1]
