"""Suffix arrays by linear grouping: Lyndon-prefix groups, then one pass that emits their order.

Suffixes are grouped by their longest Lyndon prefix.  Groups are taken in descending order;
each suffix of a group points to the nearest suffix before it that is in a lower group (its
previous smaller suffix), and a suffix pointed to moves up into a new group right above its
own, since its Lyndon prefix grows by that of the group.  In the second phase each suffix,
in ascending order, places the suffixes of which it is the next smaller one at the front of
what is left of their groups.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np

_UNSET = -2


def suffix_array(text: str) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; the end counts as smaller than any symbol."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not n or codes.max() < 1 << 16:  # sorted by counting
        codes = codes.astype(np.uint16)
    sa = np.argsort(codes, kind="stable").tolist()
    rank, place, size, before = [0] * n, [0] * n, [0] * n, [_UNSET] * n  # rank: where the group starts
    start, symbol = 0, None
    for i, s in enumerate(sa):
        if text[s] != symbol:
            start, symbol = i, text[s]
        rank[s] = start
        place[s] = i
        size[start] += 1
    i = n - 1
    while i >= 0:
        group = rank[sa[i]]
        if group == i:
            s = sa[i]
            p = s - 1
            while p >= 0 and rank[p] >= group:
                p = before[p]
            before[s] = p
            if p >= 0 and size[r := rank[p]] > 1:
                size[r] -= 1
                end = r + size[r]
                k, other = place[p], sa[end]
                sa[k], place[other] = other, k
                sa[end] = p
                rank[p] = place[p] = end
                size[end] = 1
        else:
            pointers: dict[int, int] = {}
            for first in sa[group : i + 1]:
                if before[first] != _UNSET:
                    continue
                p = first - 1
                while p >= 0 and rank[p] >= group and before[p] != _UNSET:
                    p = before[p]
                if p < 0 or rank[p] < group:
                    before[first] = p
                    if p >= 0:
                        pointers[p] = pointers.get(p, 0) + 1
                    continue
                todo = [first, p]  # leads to another one of the group, which comes first then
                while todo:
                    s = todo[-1]
                    p = s - 1
                    while p >= 0 and rank[p] >= group and before[p] != _UNSET:
                        p = before[p]
                    if p >= 0 and rank[p] >= group:
                        todo.append(p)
                        continue
                    todo.pop()
                    before[s] = p
                    if p >= 0:
                        pointers[p] = pointers.get(p, 0) + 1
            if max(pointers.values(), default=1) == 1:
                levels = {1: list(pointers)}
            else:
                levels = {}
                for p, c in pointers.items():
                    levels.setdefault(c, []).append(p)
            for c in sorted(levels, reverse=True):  # few: their sum is at most the size of the group
                moved = levels[c]
                for p in moved:
                    r = rank[p]
                    size[r] -= 1
                    end = r + size[r]
                    k, other = place[p], sa[end]
                    sa[k], place[other] = other, k
                    sa[end] = p
                    place[p] = end
                for p, r in zip(moved, [(r := rank[p]) + size[r] for p in moved], strict=True):
                    rank[p] = r
                    size[r] += 1
        i = group - 1
    free = list(range(n))  # by group: its first place not yet taken
    s, low = n, -1
    for i in range(-1, n):
        if i >= 0:
            s = sa[i]
            low = before[s]
        s -= 1
        while s != low:
            r = rank[s]
            sa[free[r]] = s
            free[r] += 1
            s = before[s]
    return sa
