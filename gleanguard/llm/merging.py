"""Rank-synchronous merging: all sequences of a batch take their lowest-rank pairs at the same time."""

from __future__ import annotations

import numpy as np


class MergeTable:
    """Merges (left id, right id) -> joined id, in order of rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.base = np.int64(max(left.max(initial=0), right.max(initial=0), joined.max(initial=0)) + 1)
        keys = left.astype(np.int64) * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined.astype(np.int64)

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged sequences, one after another in `symbols`, to their symbols after all merges and the new sizes.

        Each round finds every sequence's least rank among its neighbouring pairs and joins all pairs of that rank
        at once; sequences without a pair to join are done and leave.
        """
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = symbols.astype(np.int64)
        none, done = len(self.joined), []
        while len(symbols):
            keys = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), none - 1)
            rank = np.append(np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], none), none)
            starts = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
            lengths = np.diff(np.append(starts, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            going = least < none
            if not going.all():
                done.append((owner[~going], symbols[~going]))
                symbols, owner, rank, least = symbols[going], owner[going], rank[going], least[going]
            hit = rank == least
            # of touching pairs (a a a), every second one from the left
            edge = hit & ~np.append(False, hit[:-1])[: len(hit)]
            places = np.arange(len(hit))
            hit &= (places - np.maximum.accumulate(np.where(edge, places, 0))) % 2 == 0
            symbols = np.where(hit, self.joined[np.minimum(rank, none - 1)], symbols)
            keep = ~np.append(False, hit[:-1])[: len(hit)]
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        owner, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(sizes))
