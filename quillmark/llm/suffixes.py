"""Suffix arrays by linear grouping (no recursion, no renaming).

Phase one sorts suffixes into groups with equal longest Lyndon prefix. Groups are
taken in descending order; each member's pointer to the nearest earlier
suffix of a smaller group tells whose prefix it extends, and the extended ones
move, by how often they were extended, to new groups just above their old one.
Phase two walks the suffix array from its smallest entry and puts, along the
same pointers, every suffix at the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> list[int]:
    """Start positions of the suffixes in ascending order; symbols are non-negative integers."""
    text = np.asarray(symbols, np.int64)
    n = len(text)
    if n == 0:
        return []
    order = np.argsort(text, kind="stable")
    edge = np.flatnonzero(np.diff(text[order], prepend=-1))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group_at = np.empty(n, np.int64)
    group_at[order] = np.repeat(edge, np.diff(np.append(edge, n)))
    sa, isa, group = order.tolist(), place.tolist(), group_at.tolist()
    size = [0] * n  # by a group's first place
    for lo, hi in zip(edge.tolist(), np.append(edge[1:], n).tolist(), strict=True):
        size[lo] = hi - lo
    prev = [-1] * n
    top = n
    while top > 0:
        lo = group[sa[top - 1]]
        times: dict[int, int] = {}
        members = sa[lo:top]
        if len(members) > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1:
                layers = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    if k in by:
                        by[k].append(p)
                    else:
                        by[k] = [p]
                layers = [by[k] for k in sorted(by, reverse=True)] if len(by) > 1 else list(by.values())
            for layer in layers:
                fresh: dict[int, int] = {}
                for p in layer:  # to the end of the part of its group that still waits
                    g = group[p]
                    size[g] = left = size[g] - 1
                    e = g + left
                    at = isa[p]
                    if at != e:
                        q = sa[e]
                        sa[at] = q
                        isa[q] = at
                        sa[e] = p
                        isa[p] = e
                    fresh[g] = fresh.get(g, 0) + 1
                for p in layer:
                    g = group[p]
                    # every mover of this layer from g now lies in [g + size[g], g + size[g] + fresh[g])
                    group[p] = -(g + size[g]) - 1
                for g, k in fresh.items():
                    size[g + size[g]] = k
                for p in layer:
                    group[p] = -group[p] - 1
        top = lo
    # phase two
    free = list(range(n))  # by a group's first place, the next free place
    done = bytearray(n)
    out = [0] * n

    def put(p: int) -> None:
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = prev[p]

    put(n - 1)
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            f = free[g]
            out[f] = p
            free[g] = f + 1
            done[p] = 1
            p = prev[p]
    return out
