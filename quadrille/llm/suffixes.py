"""Suffix sorting in blocks: one bucket of suffixes at a time, long ties by the ranks of a difference cover.

Any two places of a text have a distance below the period at which both meet the cover. So
suffixes that agree in their first ``PERIOD`` bytes are put in order by the ranks of two sampled
suffixes, which are computed once for the text. Memory is bounded by the text, three ranks for
``PERIOD`` of its bytes, and one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PERIOD, COVER = 7, (0, 1, 3)
_INDEX = {c: k for k, c in enumerate(COVER)}
_VALID = [[k for k in range(PERIOD) if (r + k) % PERIOD in COVER] for r in range(PERIOD)]
#: For two residues, a distance at which both are in the cover.
_SHIFT = [[next(k for k in _VALID[a] if k in _VALID[b]) for b in range(PERIOD)] for a in range(PERIOD)]


def leading(text: np.ndarray) -> np.ndarray:
    """The first seven bytes from every place as one number; beyond the end come zeros, for a period more than the text has."""
    one = np.zeros(len(text) + 2 * PERIOD, np.uint64)
    one[: len(text)] = text
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(24)) | (four[4:] >> np.uint64(8))


def ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal ones for equal keys."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], held[1:] != held[:-1]])) if len(keys) else 0
    return out


class Suffixes:
    """Order of a text's suffixes as far as their first ``depth`` bytes tell."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.lead = depth, leading(text)
        periods = len(text) // PERIOD + 1
        cover = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        ranks, known = ranked(self.lead[cover]), PERIOD
        while known < depth and ranks.max() < len(ranks):
            ahead = np.zeros_like(ranks)
            step = len(COVER) * (known // PERIOD)
            ahead[: max(0, len(ranks) - step)] = ranks[step:]
            ranks, known = ranked(ranks * (len(ranks) + 1) + ahead), 2 * known
        self.ranks = np.concatenate([ranks, np.zeros(len(COVER), np.int64)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ranks of places in the cover."""
        residue = places % PERIOD
        return self.ranks[len(COVER) * (places // PERIOD) + np.where(residue == COVER[2], 2, residue)]

    def ordered(self, places: np.ndarray) -> np.ndarray:
        """Positions in ``places`` in the order of their suffixes."""
        keys = self.lead[places]
        order = np.argsort(keys, kind="stable")
        held = keys[order]
        new = np.concatenate([[True], held[1:] != held[:-1]])
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(tied):
            order[tied] = order[tied[self._resolved(places[order[tied]], group[tied])]]
        return order

    def _resolved(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes that are in order of ``group`` and agree in the first bytes inside it.

        Suffixes of one residue are sorted by one rank. A suffix's place is the number of those
        before it, counted for each residue by a binary search at the distance both share.
        """
        residue, most = places % PERIOD, len(self.ranks) + 1
        of = []
        for a in range(PERIOD):
            at = np.flatnonzero(residue == a)
            of.append(at[np.argsort(group[at] * most + self.rank(places[at] + _VALID[a][0]), kind="stable")])
        before = np.zeros(len(places), np.int64)
        for a in range(PERIOD):
            before[of[a]] += np.arange(len(of[a]))
            for b in range(a):
                if len(of[a]) and len(of[b]):
                    key_a, key_b = (group[of[x]] * most + self.rank(places[of[x]] + _SHIFT[a][b]) for x in (a, b))
                    before[of[a]] += np.searchsorted(key_b, key_a, "right")
                    before[of[b]] += np.searchsorted(key_a, key_b, "left")
        return np.argsort(before, kind="stable")

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``depth`` bytes from two places are equal."""
        equal = np.ones(len(a), bool)
        for k in [*range(0, self.depth - PERIOD, PERIOD), self.depth - PERIOD]:
            equal &= self.lead[a + k] == self.lead[b + k]
        return equal

    def buckets(self, places: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
        """Positions in ``places``, a bucket of about ``most`` at a time; the suffixes of one come before those of the next."""
        if len(places) <= most:
            yield np.arange(len(places))
            return
        keys = self.lead[places]
        sample = np.sort(keys[:: max(1, most // 16)])
        splits = np.unique(sample[16::16])
        of = np.searchsorted(splits, keys, "right").astype(np.int32)
        for k in range(len(splits) + 1):
            yield np.flatnonzero(of == k)

    def equal_groups(self, places: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bucket, positions in order and where in that order groups of equal first ``depth`` bytes begin."""
        for at in self.buckets(places, most):
            if len(at):
                order = at[self.ordered(places[at])]
                p = places[order]
                yield order, np.flatnonzero(np.concatenate([[True], ~self.same(p[:-1], p[1:])]))
