"""Suffix arrays by linear grouping.

Suffixes are first grouped by their longest Lyndon prefix. Groups are taken from the highest down: each of their suffixes finds its previous smaller
suffix, and the suffixes found leave their own group for a new one right above it, those found most often highest. Then the order of every
group is emitted in one ascending pass along the previous-smaller pointers. No names are made anew, and nothing is sorted recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The starts of all suffixes of an integer sequence, in lexicographic order; a proper prefix comes first."""
    n = len(symbols)
    if not n:
        return []
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    groups, places = np.empty(n, np.int64), np.empty(n, np.int64)
    groups[order] = starts[np.cumsum(new) - 1]
    places[order] = np.arange(n)
    sa, place, group, size = order.tolist(), places.tolist(), groups.tolist(), [0] * n
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        size[a] = b - a
    prev = [-1] * n

    def lift(low: int, members: list[int]) -> None:
        """Moves suffixes of the group that starts at ``low`` to a new group at its upper end."""
        size[low] -= len(members)
        top = low + size[low]
        size[top] = len(members)
        for k, p in enumerate(members, top):
            q, x = place[p], sa[k]
            sa[q], place[x], sa[k], place[p] = x, q, p, k
            group[p] = top

    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0 and size[group[p]] > 1:
                lift(group[p], [p])
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            split: dict[tuple[int, int], list[int]] = {}
            for p, t in times.items():
                split.setdefault((-t, group[p]), []).append(p)
            for t, low in sorted(split):  # those that most of the group follows go highest
                lift(low, split[t, low])
        end = start

    free, done, out = list(range(n)), bytearray(n), [-1] * n
    j, at = n - 1, 0
    while True:
        while j >= 0 and not done[j]:
            low = group[j]
            out[free[low]] = j
            free[low] += 1
            done[j] = 1
            j = prev[j]
        if at == n:
            return out
        j, at = out[at] - 1, at + 1
