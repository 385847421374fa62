"""Suffix arrays by linear grouping over Lyndon prefixes, and their common-prefix lengths."""

from __future__ import annotations

from itertools import accumulate


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` (integers >= 0) in order.

    First all suffixes are grouped by their longest Lyndon prefix. Groups start out as equal first symbols and
    are processed in descending order. Each member points to the nearest position before it
    whose group is smaller: its parent, whose prefix it extends. Parents are split off their groups by how many
    members extend them (more is greater) and become new groups just above the rest. Then, in ascending order, each
    suffix emits those that continue with it after their Lyndon prefix to the next place
    in their groups. Nothing is renamed or sorted again.
    """
    text = [x + 1 for x in s] + [0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n
    size, length = [0] * n, [1] * n
    start = 0
    for r, i in enumerate(order):
        place[i] = r
        if text[i] != text[order[start]]:
            start = r
        group[i] = start
        size[start] += 1
    before = list(range(-1, n - 1))
    end = n
    while end > 1:
        g = group[order[end - 1]]
        parents: dict[int, int] = {}
        for i in order[g:end]:
            p = before[i]
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                parents[p] = parents.get(p, 0) + 1
        own = length[g]
        end = g
        if not parents:
            continue
        by: dict[tuple[int, int], list[int]] = {}
        for p, times in parents.items():
            key = (-times, group[p])
            if key in by:
                by[key].append(p)
            else:
                by[key] = [p]
        for (times, old), moved in sorted(by.items()) if len(by) > 1 else by.items():
            k = len(moved)
            if k == size[old]:
                length[old] -= times * own
                continue
            new = old + size[old] - k
            size[old] -= k
            size[new] = k
            length[new] = length[old] - times * own
            top = new + k
            inside = {p for p in moved if place[p] >= new} if k > 1 else ()
            free = new
            for p in moved:
                at = place[p]
                if at < new:  # swaps with one of the tail that does not move
                    while k > 1 and order[free] in inside:
                        free += 1
                    q = order[free]
                    order[at], order[free] = q, p
                    place[q], place[p] = at, free
                    free += 1
                group[p] = new
            assert free <= top
    # second phase: who continues with whom
    first, follow = [-1] * n, [-1] * n
    for j in range(n - 1):
        t = j + length[group[j]]
        follow[j] = first[t]
        first[t] = j
    out, slot = [0] * n, list(range(n))
    out[0] = n - 1
    for r in range(n):
        j = first[out[r]]
        while j >= 0:
            g = group[j]
            at = slot[g]
            out[at] = j
            slot[g] = at + 1
            j = follow[j]
    return out[1:]


def common_prefixes(s: list[int], sa: list[int], stop: int) -> list[int]:
    """Symbols that the suffix at each place of ``sa`` shares with the one before it, counted up to a ``stop`` symbol."""
    n = len(s)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    out, k = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r == 0:
            k = 0
            continue
        j = sa[r - 1]
        while i + k < n and j + k < n and s[i + k] == s[j + k] != stop:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return out


def repeated_starts(s: list[int], weight: list[int], least: int, stop: int, owner: list[int] | None = None) -> list[bool]:
    """For each start whether the ``least`` units of weight from there occur at another start too, not past a ``stop``.

    With ``owner`` (one for each start) the other start must be another owner's.
    """
    if not s:
        return []
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa, stop)
    upto = [0, *accumulate(weight)]
    flags = [False] * len(s)
    first, mixed = 0, False  # the run of suffixes that share so much, and whether it has several owners
    for r in range(1, len(sa) + 1):
        if r < len(sa) and lcp[r] and upto[sa[r] + lcp[r]] - upto[sa[r]] >= least:
            mixed = mixed or owner is None or owner[sa[r]] != owner[sa[r - 1]]
            continue
        if mixed:
            for i in sa[first:r]:
                flags[i] = True
        first, mixed = r, False
    return flags
