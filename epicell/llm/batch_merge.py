"""Pair merges of many short symbol sequences at once, over numpy columns."""

from __future__ import annotations

import numpy as np

# sequences of up to so many symbols are merged together; the place of a pair takes the low bits of its entry
LONGEST = 48
PLACE_BITS = 6
NONE = np.int64(1) << np.int64(60)
EMPTY = -(np.int64(1) << np.int64(62))
ROWS = 8192
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank and result of pairs of symbols, looked up in arrays: an open hash table, a quarter full at most."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, results: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, EMPTY, dtype=np.int64)
        self.entries = np.zeros(size, dtype=np.int64)
        self.results = np.full(size, -1, dtype=np.int32)
        waiting = np.arange(len(keys))
        slot = self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == EMPTY
            # of those that want the same free slot one gets it
            self.keys[slot[free]] = keys[waiting[free]]
            placed = self.keys[slot] == keys[waiting]
            self.entries[slot[placed]] = ranks[waiting[placed]].astype(np.int64) << PLACE_BITS
            self.results[slot[placed]] = results[waiting[placed]]
            waiting, slot = waiting[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for none. Negative symbols make no pair."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        open_ = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(open_):
            at = slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (there != EMPTY)]
        return out.reshape(shape)


def merge_all(table: PairTable, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges each sequence symbols[starts[i]:starts[i + 1]] (LONGEST symbols at most) until no pair has a rank.

    The pair of lowest rank goes first, of equal ones the leftmost. Returns the symbols left, end to end, and where
    each sequence begins.
    """
    lengths = np.diff(starts)
    if len(lengths) and lengths.max() > LONGEST:
        raise ValueError("a sequence is too long")
    left = np.zeros(len(symbols), dtype=bool)
    merged = symbols.astype(np.int32).copy()
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    for lo in range(0, len(order), ROWS):
        rows = order[lo : lo + ROWS]
        _merge_block(table, merged, left, starts[rows], lengths[rows])
    keep = np.concatenate([[0], np.cumsum(left)]).astype(np.int64)
    return merged[left], keep[starts]


def _merge_block(table: PairTable, merged: np.ndarray, left: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """One block of sequences of similar length, a column each; writes what is left back in place."""
    width, n = int(lengths.max()), len(starts)
    place = np.arange(width)[:, None]
    inside = place < lengths
    symbol = np.where(inside, merged[np.minimum(starts + place, len(merged) - 1)], -1)
    after = np.broadcast_to(place + 1, (width, n)).copy()
    before = np.broadcast_to(place - 1, (width, n)).copy()
    column = np.arange(n)
    agenda = np.full((width, n), NONE, dtype=np.int64)
    slots = table.find(symbol[:-1], symbol[1:])
    agenda[:-1] = np.where(slots >= 0, table.entries[slots] | place[:-1], NONE)
    alive = inside
    todo = column
    view = agenda
    while len(todo):
        best = view.min(axis=0)
        busy = best < NONE
        if not busy.all():
            todo, best = todo[busy], best[busy]
            if not len(todo):
                break
            view = view[:, busy]
        at = best & ((1 << PLACE_BITS) - 1)
        nxt = after[at, todo]
        new = table.results[table.find(symbol[at, todo], symbol[nxt, todo])]
        symbol[at, todo] = new
        alive[nxt, todo] = False
        far = after[nxt, todo]
        after[at, todo] = far
        local = np.arange(len(todo))
        view[nxt, local] = NONE
        has = far < lengths[todo]
        entry = np.full(len(todo), NONE, dtype=np.int64)
        if has.any():
            before[far[has], todo[has]] = at[has]
            found = table.find(new[has], symbol[far[has], todo[has]])
            entry[has] = np.where(found >= 0, table.entries[found] | at[has], NONE)
        view[at, local] = entry
        back = before[at, todo]
        has = back >= 0
        if has.any():
            found = table.find(symbol[back[has], todo[has]], new[has])
            view[back[has], local[has]] = np.where(found >= 0, table.entries[found] | back[has], NONE)
    flat = (starts + place)[inside]
    merged[flat] = symbol[inside]
    left[flat] = alive[inside]
