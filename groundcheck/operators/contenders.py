"""Which passages of one group can be among a claim's k best, whatever the other groups hold.

The combined score grows with the lexical and the dense score, but the lexical
one is divided by the claim's best over all passages, which no group knows.  A
passage that k others of its group exceed in one score and reach in the other
is not among the k best for any divisor, and all others are kept: the k-skyband
of the two scores, a few dozen passages a claim.

Blocks of passages know the largest weight of each token.  Where the sum of
these and the block's best dense score are already exceeded, the block's lexical
scores are not taken at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Weights of the lexical score by which the k best so far are kept, to tell what they exceed; None: by the lesser of both scores.
MIXES = (0.9, None, 0.15)
#: Passages up to which the skyband is taken exactly; of more, what the k best of each mix leave is kept.
EXACT = 1024
#: Scores are told apart at 12 decimals.
APART = 2e-12


class Best:
    """For each mix the k best passages of every claim so far."""

    def __init__(self, claims: int, k: int, mixes: tuple[float | None, ...], scale: np.ndarray, apart: tuple[np.ndarray, float]):
        self.k, self.mixes, self.scale = k, mixes, scale[:, None]
        self.apart_s, self.apart_e = apart[0][:, None], apart[1]
        self.value, self.s, self.e = (np.full((len(mixes), claims, k), -np.inf) for _ in range(3))

    def add(self, s: np.ndarray, e: np.ndarray) -> None:
        for m, share in enumerate(self.mixes):
            value = np.minimum(s / self.scale, e) if share is None else share * s / self.scale + (1 - share) * e
            value = np.concatenate([self.value[m], value], axis=1)
            near = np.argpartition(-value, self.k - 1, axis=1)[:, : self.k]
            take = lambda old, new: np.take_along_axis(np.concatenate([old, new], axis=1), near, axis=1)  # noqa: B023, E731
            self.value[m], self.s[m], self.e[m] = np.take_along_axis(value, near, axis=1), take(self.s[m], s), take(self.e[m], e)

    def exceed(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """True where the k best of some mix are above in one score and not below in the other."""
        out = np.zeros(s.shape, bool)
        for low_s, low_e in zip(self.s.min(axis=2), self.e.min(axis=2)):
            low_s, low_e = low_s[:, None], low_e[:, None]
            out |= (s < low_s - self.apart_s) & (e <= low_e) | (s <= low_s) & (e < low_e - self.apart_e)
        return out


def _skyband(s: np.ndarray, e: np.ndarray, k: int, apart_s: float, apart_e: float) -> np.ndarray:
    if not k < len(s) <= EXACT:
        return np.ones(len(s), bool)
    above = (s >= s[:, None]) & (e >= e[:, None]) & ((s > s[:, None] + apart_s) | (e > e[:, None] + apart_e))
    return above.sum(axis=1) < k


def contenders(claims: int, blocks: Sequence, bound: Callable, lexical: Callable, dense: Callable | None, k: int, weights: tuple[float, float], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Claims, passages, lexical and dense scores of what is kept, by claim, then passage; and the number of blocks passed over.

    ``bound``, ``lexical`` and ``dense`` are asked for a block's values, ``most``
    bounds every claim's lexical score over all groups.  A weight of 0 leaves its
    score out of the comparison.
    """
    counts = [float(w > 0) for w in weights]
    mixes = MIXES if all(counts) else (counts[0],)
    apart = APART / weights[0] * np.maximum(most, 1) if counts[0] else np.zeros(claims), APART / weights[1] if counts[1] else 0.0
    bounds = [bound(block) for block in blocks]
    scale = np.maximum(np.max(bounds, axis=0, initial=0.0), 1e-300) if bounds else np.ones(claims)
    best, kept, over = Best(claims, k, mixes, scale, apart), [], 0
    for block, limit in zip(blocks, bounds):
        first, size = block[0], block[1] - block[0]
        e = dense(block) if dense else np.zeros((claims, size))
        if best.exceed(counts[0] * limit[:, None], counts[1] * e.max(axis=1, initial=0)[:, None]).all():
            over += 1
            continue
        s = lexical(block)
        best.add(counts[0] * s, counts[1] * e)
        claim, passage = np.nonzero(~best.exceed(counts[0] * s, counts[1] * e))
        kept.append((claim, first + passage, s[claim, passage], e[claim, passage]))
    if not kept:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), np.zeros(0), over
    claim, passage, s, e = (np.concatenate(c) for c in zip(*kept))
    order = np.argsort(claim, kind="stable")
    claim, passage, s, e = claim[order], passage[order], s[order], e[order]
    use, edge = np.zeros(len(claim), bool), np.searchsorted(claim, np.arange(claims + 1))
    low_s, low_e = best.s.min(axis=2), best.e.min(axis=2)
    for c, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        if a == b:
            continue
        own_s, own_e, stays = counts[0] * s[a:b], counts[1] * e[a:b], np.ones(b - a, bool)
        for m in range(len(mixes)):  # once more, with the best of all blocks
            stays &= ~((own_s < low_s[m, c] - apart[0][c]) & (own_e <= low_e[m, c]) | (own_s <= low_s[m, c]) & (own_e < low_e[m, c] - apart[1]))
        at = np.flatnonzero(stays)
        use[a + at[_skyband(own_s[at], own_e[at], k, apart[0][c], apart[1])]] = True
    return claim[use], passage[use], s[use], e[use], over
