"""Blockwise suffix sorting with a difference cover, for one text in memory.

Places whose remainder modulo 7 is in the cover {0, 1, 3} form the sample; their
suffixes are ranked first, by doubling. For any two places there is an offset
below 7 that takes both into the sample. So the other suffixes are sorted bucket
by bucket: by their first seven bytes, and ties by the ranks at that offset. Only
one bucket of suffixes is held at a time, however long the ties are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MODULUS, COVER = 7, (0, 1, 3)
#: Suffixes in one bucket, or as many as share their first two bytes.
BUCKET = 1 << 19
PAD = 64


def _offset(a: int, b: int) -> int:
    return next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)


OFFSETS = np.array([[_offset(a, b) for b in range(MODULUS)] for a in range(MODULUS)])


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian integers; zeros follow the text."""
    data = text.tobytes() + b"\0" * PAD
    return np.ndarray((len(text) + PAD - 8,), ">u8", data, 0, (1,)).astype(np.uint64)


class SuffixSorter:
    """Orders suffixes by their first ``depth`` bytes at least; those that agree in them stand together."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.n, self.depth = len(text), depth
        self.word = words(text)
        at = np.arange(self.n)
        sample = at[np.isin(at % MODULUS, COVER)]
        self.rank = np.zeros(self.n + 2 * depth + PAD, np.uint64)
        self.rank[sample] = np.unique(self.word[sample] >> np.uint64(8), return_inverse=True)[1] + 1
        step = MODULUS
        while step < depth:
            pair = self.rank[sample] << np.uint64(32) | self.rank[sample + step]
            self.rank[sample] = np.unique(pair, return_inverse=True)[1] + 1
            step *= 2

    def buckets(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """The places in the order of their suffixes, one bucket after another."""
        if not len(places):
            return
        first = (self.word[places] >> np.uint64(48)).astype(np.int64)
        counts = np.bincount(first, minlength=1 << 16)
        bucket = (np.cumsum(counts) - counts) // BUCKET
        which = bucket[first]
        order = np.argsort(which, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            yield self._sorted(places[part])

    def _sorted(self, p: np.ndarray) -> np.ndarray:
        key = self.word[p] >> np.uint64(8)
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        if tied.any():
            out = p.copy()
            out[tied] = self._untied(p[tied], group[tied])
            return out
        return p

    def _untied(self, p: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Places sorted by group; within a group by the cover's ranks, class by class, and the classes merged."""
        kind = p % MODULUS
        base = np.searchsorted(group, np.arange(group[-1] + 1))
        lists = []
        for c in range(MODULUS):
            own = np.flatnonzero(kind == c)
            order = np.argsort(self._key(p[own], group[own], OFFSETS[c, c]), kind="stable")
            lists.append(own[order])
        places = np.empty_like(p)
        for c, own in enumerate(lists):
            if not len(own):
                continue
            g = group[own]
            place = base[g]
            for d, other in enumerate(lists):
                if c == d or not len(other):
                    less = np.searchsorted(group[other], g) if len(other) else 0
                    place = place + (np.arange(len(own)) - less if c == d else 0)
                    continue
                mine = self._key(p[own], g, OFFSETS[c, d])
                theirs = self._key(p[other], group[other], OFFSETS[c, d])
                start = np.searchsorted(group[other], g)
                at = np.searchsorted(theirs, mine, "left" if c < d else "right")
                place = place + np.clip(at - start, 0, None)
            places[own] = place
        # Suffixes that agree beyond the ranks' depth may share a place, but no other suffix comes between them.
        return p[np.argsort(places, kind="stable")]

    def _key(self, p: np.ndarray, group: np.ndarray, offset: int) -> np.ndarray:
        return group.astype(np.uint64) << np.uint64(32) | self.rank[p + offset]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree in their first ``depth`` bytes."""
        same = np.ones(len(a), bool)
        for i in [*range(0, self.depth - 7, 8), self.depth - 8]:
            same &= self.word[a + i] == self.word[b + i]
        return same

    def groups(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, start of each group): suffixes that agree in ``depth`` bytes, for each bucket."""
        for p in self.buckets(places):
            same = self.alike(p[:-1], p[1:])
            yield p, np.flatnonzero(np.concatenate([[True], ~same]))
