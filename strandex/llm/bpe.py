"""Byte-pair encoding by vectorised merge rounds over flat symbol arrays.

All distinct words of a slice are encoded together. A round finds the lowest pair rank of
each word by a segmented minimum, merges all pairs of that rank at once, the leftmost of
those that overlap, compacts the arrays and looks up only the new neighbours; words
without a pair leave. That is the order of a sequential encoder wherever no merge of the
round makes a pair of a lower rank; for the few merges whose symbol has such a pair,
`alone`, a word takes the leftmost one in that round.

Words are first cut between neighbours that no symbol holds side by side: no merge can
cross there, so the parts are words of their own.
"""

from __future__ import annotations

import numpy as np

from .flat import U8, offsets, spread, sums

_NONE = np.int64(1 << 30)
_EMPTY = U8(0xFFFFFFFFFFFFFFFF)


class HashTable:
    """Open addressing from 64-bit keys to int32 values, -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int | None = None):
        self.bits = bits or max(10, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full(1 << self.bits, _EMPTY, U8)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.used = 0
        self.add(keys.astype(U8), values.astype(np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U8(0x9E3779B97F4A7C15)) >> U8(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        self.used += len(keys)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        more = np.flatnonzero((found != keys) & (found != _EMPTY))
        mask = (1 << self.bits) - 1
        while len(more):
            slot[more] = (slot[more] + 1) & mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found != _EMPTY)]
        return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(U8) << U8(32)) | b.astype(U8)


class Merges:
    """left, right: symbol ids; rank: lower merges first; made: the id of the merged symbol."""

    def __init__(self, left, right, rank, made):
        self.left, self.right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.rank, self.made = np.asarray(rank, np.int64), np.asarray(made, np.int32)
        self.table = HashTable(pair_key(self.left, self.right), np.arange(len(self.left)))
        # the lowest rank of a pair that the merged symbol is in
        names = np.unique(np.concatenate([self.left, self.right, self.made]))
        l, r, m = (np.searchsorted(names, x) for x in (self.left, self.right, self.made))
        lowest = np.full(len(names), _NONE)
        np.minimum.at(lowest, l, self.rank)
        np.minimum.at(lowest, r, self.rank)
        self.alone = lowest[m] <= self.rank
        # first and last basic symbol of every symbol, and the neighbours that merges bring together
        first = last = np.arange(len(names))
        while True:
            f, z = first.copy(), last.copy()
            f[m], z[m] = first[l], last[r]
            if (f == first).all() and (z == last).all():
                break
            first, last = f, z
        beside = np.unique(pair_key(names[last[l]], names[first[r]]))
        self.beside = HashTable(beside, np.zeros(len(beside)))

    def entries(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table.get(pair_key(a, b))

    def encode(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of words, and symbols of each word (none is empty) -> flat ids, ids of each word."""
        if not len(symbols):
            return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
        begin = np.zeros(len(symbols), bool)
        begin[1:] = self.beside.get(pair_key(symbols[:-1], symbols[1:])) < 0
        begin[np.cumsum(counts) - counts] = True
        starts = np.flatnonzero(begin)
        ids, n = self._merged(symbols.astype(np.int32), np.diff(np.append(starts, len(symbols))))
        return ids, sums(n, np.searchsorted(starts, offsets(counts)))

    def _merged(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.arange(len(counts))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        entry = np.full(len(sym), -1, np.int32)
        entry[:-1] = self.entries(sym[:-1], sym[1:])
        entry[np.cumsum(counts) - 1] = -1
        rank = np.where(entry >= 0, self.rank[entry], _NONE)
        while len(sym):
            low = np.minimum.reduceat(rank, np.cumsum(counts) - counts)
            if len(gone := np.flatnonzero(low == _NONE)):
                at = np.repeat(low == _NONE, counts)
                done.append((words[gone], sym[at], counts[gone]))
                live, at = low != _NONE, ~at
                sym, entry, rank = sym[at], entry[at], rank[at]
                words, counts, low = words[live], counts[live], low[live]
            pos = np.flatnonzero(rank == np.repeat(low, counts))
            if not len(pos):
                break
            ends = np.cumsum(counts)
            owner = np.searchsorted(ends, pos, side="right")
            # of pairs that follow each other every second one, counted from the leftmost
            run = np.ones(len(pos), bool)
            run[1:] = pos[1:] != pos[:-1] + 1
            place = np.arange(len(pos))
            take = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            take[1:] &= ~(self.alone[entry[pos[1:]]] & (owner[1:] == owner[:-1]))
            pos, owner = pos[take], owner[take]
            sym[pos] = self.made[entry[pos]]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, entry, rank = sym[keep], entry[keep], rank[keep]
            counts = counts - np.bincount(owner, minlength=len(counts))
            ends = np.cumsum(counts)
            pos = pos - np.arange(len(pos))
            for at, ok in ((pos, pos + 1 < ends[owner]), (pos - 1, pos > (ends - counts)[owner])):
                here = at[ok]
                e = self.entries(sym[here], sym[here + 1])
                entry[here], rank[here] = e, np.where(e >= 0, self.rank[e], _NONE)
                if at is pos:
                    entry[at[~ok]], rank[at[~ok]] = -1, _NONE
        w, c = np.concatenate([d[0] for d in done]), np.concatenate([d[2] for d in done])
        flat, order = np.concatenate([d[1] for d in done]), np.argsort(w, kind="stable")
        first = (np.cumsum(c) - c)[order]
        return flat[spread(first, c[order])], c[order]
