"""PartEnum signatures of sets under a Jaccard similarity of at least `percent` hundredths.

Sizes fall into bands. An instance of the scheme covers the pairs whose smaller set lies in its band; a set takes
part in the instance of its own band, and in a lower one if a set there may still link with it. Sets that link and
take part in one instance differ in at most d = (100-p)/(100+p) * (sum of both sizes) features.

Two levels: the feature domain is cut by hash into n1 partitions, each of these into n2 second-level partitions.
For each first-level partition all subsets of n2 - k2 of its second-level partitions are enumerated, and each is
a signature: a hash of the features in it. If d features differ, some first-level partition holds at most k2 of
them (n1 * (k2 + 1) > d), so they spoil at most k2 of its second-level ones and a subset without these is alike in
both sets: sets that are similar enough share a signature.

Fewer signatures: of the T of a set, d differing features spoil at most D (by counting; `spoilt`). If all are put
in one order that depends on the signature alone, the first D + 1 of each of two sets share one whenever the sets
share T - D (the prefix principle). The order puts signatures of many features first, as those of few match by
chance, and n1 has some partitions to spare, so that signatures of hardly any features come last and drop out.

Each instance takes, of a few pairs (k2, n2), the one for which the number of signatures kept of a set in the
middle of the band, times one plus the expected chance matches, is least; the latter are taken as `WEAK` times the
share of kept signatures with two features or fewer. Subsets are enumerated at every size. The number of signatures
grows with the size all the same: d grows with it, and a family of parts of the domain of which d differing features,
wherever they lie, leave one untouched has more than d members. What the subsets buy is features per signature (4/3 of
those of a single-level partitioning with (1, 3), 3/2 with (1, 4) and (2, 4)), so fewer chance matches. Sets that link with equal sets only need no signatures, as equal sets are found by hash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, exp
from typing import NamedTuple

import numpy as np

from .shingles import M1, M2, mix

#: (k2, n2) to choose from, all with subsets of two or more of the n2 second-level partitions (with k2 = 0 or subsets
#: of one, the two levels would be one partitioning without enumeration); a band spans this power of 100 / percent.
SHAPES, SPAN, WEAK = ((1, 3), (1, 4), (2, 4), (2, 5), (3, 6)), 2, 20.0


class Scheme(NamedTuple):
    n1: int
    k2: int
    n2: int
    spoilt: np.ndarray  # by number of differing features

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """The first size of each band."""
    firsts = [1]
    while firsts[-1] < largest:
        firsts.append(max(firsts[-1] + 1, int(firsts[-1] * (100 / percent) ** SPAN)))
    return np.array(firsts, np.int64)


def sizes_of(percent: int, instance: int) -> tuple[int, int, int]:
    """The smallest and largest size of the band, and the largest size that links with one in it."""
    first, after = bands(percent)[instance : instance + 2].tolist()
    return first, after - 1, (after - 1) * 100 // percent


def difference(percent: int, total: int) -> int:
    """How many features two sets that link, of `total` features together, differ in at most."""
    return (100 - percent) * total // (100 + percent)


def _spoilt(n1: int, k2: int, n2: int, most: int) -> np.ndarray:
    """The most signatures that 0, 1, .. `most` differing features spoil: the first to hit a first-level partition
    spoils the most, each further second-level partition hit in it fewer."""
    m = n2 - k2
    steps = np.repeat([comb(n2 - t - 1, m - 1) for t in range(n2)], n1)[:most]
    return np.concatenate([[0], np.cumsum(np.concatenate([steps, np.zeros(most - len(steps), np.int64)]))])


@lru_cache(maxsize=512)
def scheme(percent: int, instance: int) -> Scheme | None:
    """None where only equal sets link."""
    first, last, top = sizes_of(percent, instance)
    k = difference(percent, last + top)
    if k == 0:
        return None
    best, least = None, float("inf")
    for k2, n2 in SHAPES:
        n1 = -(-(k + 1) // (k2 + 1)) + (1 + k // 20 if k > 4 else 0)
        spoilt = _spoilt(n1, k2, n2, k)
        size = (first + last) // 2
        kept, total = int(spoilt[difference(percent, size + size * 100 // percent)]) + 1, n1 * comb(n2, k2)
        held = size * (n2 - k2) / (n1 * n2)
        weak = exp(-held) * (1 + held + held**2 / 2) - (1 - kept / total)
        cost = kept * (1 + WEAK * max(0.0, weak))
        if cost < least:
            best, least = Scheme(n1, k2, n2, spoilt), cost
    return best


def takes_part(percent: int, size: int) -> list[tuple[int, int]]:
    """(instance, signatures to keep) of a set of this size."""
    band, out = int(np.searchsorted(bands(percent), size, "right")) - 1, []
    for instance in range(band, -1, -1):
        _, last, top = sizes_of(percent, instance)
        if size > top:
            break
        partner = size * 100 // percent if size <= last else last
        d = difference(percent, size + partner)
        if d:
            out.append((instance, int(scheme(percent, instance).spoilt[d]) + 1))
    return out


def signatures(features: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, ends) of sets given one after the other: 64-bit numbers, small ones for many features."""
    sizes = np.diff(ends, prepend=0)
    known: dict[int, list] = {}
    rows = []  # (shape, instance, set, keep)
    for k, size in enumerate(sizes.tolist()):
        if size and size not in known:
            known[size] = [(scheme(percent, i), i, keep) for i, keep in takes_part(percent, size)]
        rows += [(s.n2, s.k2, s.n1, i, k, keep) for s, i, keep in known.get(size, ())]
    rows.sort()
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    at = 0
    while at < len(rows):
        stop, total = at, 0
        while stop < len(rows) and rows[stop][:2] == rows[at][:2] and (stop == at or total < 2_000_000):
            total += int(sizes[rows[stop][4]]) + rows[stop][0] * rows[stop][2]
            stop += 1
        for (*_, k, _), kept in zip(rows[at:stop], _of_one_shape(features, ends, sizes, rows[at:stop]), strict=True):
            out[k].append(kept)
        at = stop
    lengths = [sum(map(len, parts)) for parts in out]
    return np.concatenate([np.zeros(0, np.uint64), *[x for parts in out for x in parts]]), np.cumsum(lengths)


def _of_one_shape(features: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rows: list[tuple]) -> list[np.ndarray]:
    """The signatures to keep of each row; all rows have one (n2, k2)."""
    n2, k2 = rows[0][:2]
    n1, instance, of = (np.array([r[c] for r in rows], np.int64) for c in (2, 3, 4))
    n, cells = sizes[of], n1 * n2
    taken = np.repeat(ends[of] - np.cumsum(n), n) + np.arange(int(n.sum()))
    x = features[taken]
    place = ((mix(x + M1) >> np.uint64(32)) * np.repeat(cells, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    place += np.repeat(np.cumsum(cells) - cells, n)
    total = int(cells.sum())
    sums, counts = np.zeros(total, np.uint64), np.bincount(place, minlength=total)
    np.add.at(sums, place, mix(x ^ M2))
    sums, counts = sums.reshape(-1, n2), counts.reshape(-1, n2)
    number = np.arange(len(sums)) - np.repeat(np.cumsum(n1) - n1, n1)
    salt = (np.repeat(instance, n1) << 40 | number << 8).astype(np.uint64)
    subsets = list(combinations(range(n2), n2 - k2))
    keys = np.empty((len(sums), len(subsets)), np.uint64)
    for s, subset in enumerate(subsets):
        value, held = sums[:, subset].sum(1, dtype=np.uint64), np.minimum(counts[:, subset].sum(1), 255)
        keys[:, s] = (255 - held).astype(np.uint64) << np.uint64(56) | mix(value + mix(salt + np.uint64(s))) >> np.uint64(8)
    keys, last, kept = keys.ravel(), np.cumsum(n1) * len(subsets), []
    for row, a, b in zip(rows, (last - n1 * len(subsets)).tolist(), last.tolist(), strict=True):
        kept.append(np.partition(keys[a:b], row[5] - 1)[: row[5]] if row[5] < b - a else keys[a:b])
    return kept
