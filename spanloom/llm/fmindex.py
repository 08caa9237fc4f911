"""A full-text index of one shard: suffix array, Burrows-Wheeler transform and
wavelet matrix over word numbers."""

from __future__ import annotations

import numpy as np


def suffix_array(w: np.ndarray) -> np.ndarray:
    """Order of the suffixes of w, whose last word must be smaller than all
    others. The first sort takes as many words as fit into 63 bits; then the
    compared length doubles for the suffixes that are still tied."""
    n = len(w)
    bits = max(1, int(w.max(initial=0)).bit_length())
    k = max(1, 63 // bits)
    padded = np.concatenate([w, np.zeros(k, w.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key = (key << bits) | padded[i : i + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[n] = -1
    alone = new.copy()
    alone[:-1] &= new[1:]
    tied = np.flatnonzero(~alone)
    while len(tied):
        pos = sa[tied]
        key = (rank[pos] << 32) | (rank[np.minimum(pos + k, n)] + 1)
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[tied] = pos
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[pos] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new
        alone[:-1] = alone[:-1] & new[1:].copy()
        tied = tied[~alone]
        k *= 2
    return sa


class Bits:
    """A bitmap with rank: ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class FMIndex:
    """Backward search and location in a text of words >= 1. sample: every
    sample-th place of the text is kept, others are found by steps back."""

    def __init__(self, w: np.ndarray, sample: int = 8):
        w = np.concatenate([w, [0]]).astype(np.int64)
        self.n = n = len(w)
        sa = suffix_array(w)
        x = w[sa - 1]
        top = int(w.max())
        self.start = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=top + 1))])
        self.top, self.levels = top, max(1, top.bit_length())
        self.bits, self.zeros = [], []
        for lev in range(self.levels - 1, -1, -1):
            one = ((x >> lev) & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(n - one.sum()))
            x = np.concatenate([x[~one], x[one]])
        keep = sa % sample == 0
        self.marked, self.places = Bits(keep), sa[keep]

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often word c stands before row i of the transform."""
        lo = np.zeros(len(i), np.int64)
        for lev, (b, z) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - lev)) & 1 != 0
            ri, rl = b.rank(i), b.rank(lo)
            i = np.where(one, z + ri, i - ri)
            lo = np.where(one, z + rl, lo - rl)
        return i - lo

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        i, c, lo = row, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for b, z in zip(self.bits, self.zeros, strict=True):
            one = b.get(i)
            ri, rl = b.rank(i), b.rank(lo)
            i = np.where(one, z + ri, i - ri)
            lo = np.where(one, z + rl, lo - rl)
            c = (c << 1) | one
        return self.start[c] + i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi of each phrase (rows of a matrix of words; words that the
        text lacks are 0 or above its largest)."""
        m, k = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        known = ((phrases > 0) & (phrases <= self.top)).all(axis=1)
        at = np.flatnonzero(known)
        last = phrases[at, k - 1]
        a, b = self.start[last], self.start[last + 1]
        for j in range(k - 2, -1, -1):
            go = b > a
            at, a, b = at[go], a[go], b[go]
            c = phrases[at, j]
            a, b = self.start[c] + self._rank(c, a), self.start[c] + self._rank(c, b)
        lo[at], hi[at] = a, b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in rows."""
        out = np.empty(len(rows), np.int64)
        at, r, steps = np.arange(len(rows)), rows, 0
        while len(at):
            hit = self.marked.get(r)
            out[at[hit]] = self.places[self.marked.rank(r[hit])] + steps
            at, r = at[~hit], r[~hit]
            if len(at):
                r = self._back(r)
                steps += 1
        return out
