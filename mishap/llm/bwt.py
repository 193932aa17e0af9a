"""Bounded common prefixes from a Burrows-Wheeler transform, by increasing value.

A boundary at rank p with value v says that the suffixes of ranks p - 1 and p share just v bytes:
it parts two intervals of strings of v + 1 bytes. Extending those to the left by a byte c parts
the intervals of c-strings one byte longer. With LF the step from a rank to the rank of the suffix
one byte longer, and a < b neighbouring ranks of the same preceding byte, the boundary LF(b) has
the value 1 + (smallest value in (a, b]). So values come out breadth first: all boundaries of value
v, then from them all of value v + 1, and the search ends at the minimum length. Ranks between which
no boundary was found by then start with equal strings of at least that length.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the first `depth` bytes (more than that at times). The text counts
    as followed by zero bytes; ties are in the order of the text."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del key, ordered
    rank = np.empty(n + 1, np.int64)  # of the first suffix of its group, from 1; 0 stands for the end
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n))) + 1
    rank[n] = 0
    h = 8
    while h < depth:
        step = min(h, depth - h)
        # places in groups of more than one
        size = np.diff(np.append(start, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        at = order[tied]
        second = rank[np.minimum(at + step, n)]
        both = (rank[at] << 32) | second
        by = np.argsort(both)
        both = both[by]
        order[tied] = at[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[tied] = fresh
        start = np.flatnonzero(new)
        group = np.cumsum(fresh) - 1
        rank[order[tied]] = tied[fresh][group] + 1
        h += step
    return order


def bounded_boundaries(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """By rank: whether the suffix shares fewer than `least` bytes with the one before it."""
    n = len(text)
    bwt = text[order - 1]  # the text counts as a circle: the first byte is preceded by the last
    by_byte = np.argsort(bwt, kind="stable")  # ranks by preceding byte: place in this list is LF
    lf = np.empty(n, np.int64)
    lf[by_byte] = np.arange(n)
    found = np.zeros(n, bool)
    # value 0: where the first byte changes
    first = np.flatnonzero(np.append(True, np.diff(np.sort(bwt)) != 0))
    found[first] = True
    same = np.zeros(n, bool)  # the rank before has the same preceding byte
    same[1:] = bwt[1:] == bwt[:-1]
    # the other ranks b with the closest rank a < b of the same byte; their boundaries are found once
    inner = np.ones(n, bool)
    inner[first] = False
    b = by_byte[inner]
    a = by_byte[np.flatnonzero(inner) - 1]
    far = a < b - 1
    a, b = a[far], b[far]
    frontier = first
    for _ in range(least - 1):
        if not len(frontier):
            break
        near = lf[frontier[same[frontier]]]
        parts = [near[~found[near]]]
        if len(b):
            if len(frontier) * 8 > n:
                upto = np.zeros(n, np.int32)
                upto[frontier] = 1
                np.cumsum(upto, out=upto)
                hit = upto[b] > upto[a]
            else:
                p = np.sort(frontier)
                i = np.searchsorted(p, a, "right")
                hit = p[np.minimum(i, len(p) - 1)] <= b
                hit &= (i < len(p)) & (p[np.minimum(i, len(p) - 1)] > a)
            if hit.any():
                far_new = lf[b[hit]]
                parts.append(far_new[~found[far_new]])
                a, b = a[~hit], b[~hit]
        frontier = np.concatenate(parts)
        found[frontier] = True
    return found


def repeated(text: np.ndarray, least: int, weight: np.ndarray | int, sure: np.ndarray) -> np.ndarray:
    """By position: whether the `least` bytes that start there start elsewhere too.

    weight: times that the position stands for. sure: positions that count, those whose strings
    hold no 0xFF: that byte is a separator, and one is set behind the text, since a transform
    takes it for a circle and only strings over its seam may be out of order."""
    n = len(text)
    out = np.zeros(n, bool)
    if n == 0:
        return out
    closed = np.append(text, np.uint8(0xFF))
    order = sorted_suffixes(closed, least)
    start = np.flatnonzero(bounded_boundaries(closed, order, least))
    counted = np.append(np.where(sure, weight, 0), 0)
    times = np.add.reduceat(counted[order], start)
    found = np.empty(n + 1, bool)
    found[order] = np.repeat(times > 1, np.diff(np.append(start, n + 1)))
    return found[:n] & sure
