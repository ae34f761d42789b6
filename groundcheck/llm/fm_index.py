"""An FM-index over integer symbols: wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order (a shorter prefix first), by doubling over those still tied."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    sa = np.argsort(s, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = s[sa[1:]] != s[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    heads = np.flatnonzero(new)
    rank[sa] = heads[np.cumsum(new) - 1] + 1  # 1 + the first place of its group
    rank[n] = 0
    h = 1
    while True:
        size = np.diff(np.append(heads, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return sa
        at = sa[tied]
        own, after = rank[at], rank[np.minimum(at + h, n)]
        order = np.lexsort((after, own))
        at, own, after = at[order], own[order], after[order]
        sa[tied] = at
        split = np.empty(len(tied), bool)
        split[0] = True
        split[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new = np.ones(n, bool)
        new[tied] = split
        heads = np.flatnonzero(new)
        place = np.flatnonzero(split)
        rank[at] = tied[place[np.cumsum(split) - 1]] + 1
        h *= 2


class BitRank:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """The number of ones among the first ``i`` bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of any symbol and access to any place, level by level from the top bit."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            on = (s >> bit & 1).astype(bool)
            self.levels.append((bit, BitRank(on), int(len(s) - on.sum())))
            s = np.concatenate([s[~on], s[on]])

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place ``i`` of each symbol ``c``'s block lies at the bottom; less ``descend(c, 0)`` it is c's rank."""
        for bit, bits, zeros in self.levels:
            one = bits.ones(i)
            i = np.where(c >> bit & 1, zeros + one, i - one)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its place at the bottom."""
        c = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            on, one = bits[i], bits.ones(i)
            i = np.where(on, zeros + one, i - one)
            c |= on.astype(np.int64) << bit
        return c, i


class FMIndex:
    """Search phrases in a text of symbols 0 to ``sigma`` - 1 and find where they occur."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = 32) -> None:
        # symbols move up by one; 0 is the end mark
        t = np.append(np.asarray(s, np.int64) + 1, 0)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        self.n, self.sigma = len(t), sigma + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])
        self.tree = WaveletMatrix(bwt, self.sigma)
        self.base = self.tree.descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        kept = sa % sample == 0
        self.marked, self.kept = BitRank(kept), sa[kept]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges lo, hi of every phrase (rows, left-aligned, ``size`` symbols each), by backward search."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        for k in range(int(size.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero((size > k) & (lo < hi))
            if not len(live):
                continue
            c = phrases[live, k].astype(np.int64) + 1
            start = self.first[c] - self.base[c]
            lo[live] = start + self.tree.descend(c, lo[live])
            hi[live] = start + self.tree.descend(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, walking back to the nearest sampled one."""
        found, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            here = rows[live]
            hit = self.marked[here]
            found[live[hit]] = self.kept[self.marked.ones(here[hit])] + steps[live[hit]]
            live = live[~hit]
            c, down = self.tree.access(rows[live])
            rows[live] = self.first[c] + down - self.base[c]
            steps[live] += 1
        return found
