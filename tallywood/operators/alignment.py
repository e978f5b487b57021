"""The blocks that two texts' lines have in common, as difflib finds them, for texts of any length.

SequenceMatcher(None, a, b, autojunk=False) takes the longest common block, the first in a and then in b among equals, and goes
on to its left and right. Each block costs it all pairs of equal lines there are, so a large file whose lines repeat takes
hours. The same blocks are found here by length: of one length, all are taken in one pass from left to right, and what lies between
them has shorter ones only. As blocks don't overlap, there are no more lengths than the root of twice the lines.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Lines up to which difflib is asked itself: it is faster there, and gives the same.
FEW = 400


def _numbered(x: np.ndarray) -> np.ndarray:
    """A number from 0 on for each different value."""
    return pa.array(x).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the common blocks in order; blocks that touch aren't joined."""
    known: dict[str, int] = {}
    lines = np.array([known.setdefault(x, len(known)) for side in (a, b) for x in side], np.int64)
    n, m = len(lines), len(a)
    runs = [lines]  # runs[k][p]: the number of the 2 ** k lines from p on

    def windows(p: np.ndarray, size: int) -> np.ndarray:
        k = size.bit_length() - 1
        while len(runs) <= k:
            half = 1 << len(runs) - 1
            runs.append(_numbered(runs[-1][:-half] * n + runs[-1][half:]))
        return _numbered(runs[k][p] * n + runs[k][p + size - (1 << k)])

    # a gap is what lies between blocks that were taken: its number and its end for each line, -1 where it is settled
    gap, end = np.zeros(n, np.int64), np.repeat([m, n], [m, n - m])
    spans = {0: (0, m, m, n)}

    def shared(p: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the places p and q, those from which as many lines are found in the other side of the gap, and numbers of these lines."""
        p, q = p[p + size <= end[p]], q[q + size <= end[q]]
        both = np.concatenate([p, q])
        same = _numbered(windows(both, size) * (len(spans) + 1) + gap[both]) if len(p) and len(q) else np.zeros(len(both), np.int64)
        x, y = same[: len(p)], same[len(p) :]
        in_p, in_q = (np.bincount(z, minlength=len(both) + 1) > 0 for z in (x, y))
        return p[in_q[x]], q[in_p[y]], x[in_q[x]], y[in_p[y]]

    # what was found of lesser sizes holds all that there is of larger ones, in these gaps and in those that they fall into
    out, most, kept = [], min(m, n - m), [(1, np.arange(m), np.arange(m, n))]
    while kept:
        size, p, q = kept.pop()
        if size > most:
            continue
        found = shared(p[gap[p] >= 0], q[gap[q] >= 0], size)
        if not len(found[0]):
            most = size - 1
            continue
        kept.append((size, *found[:2]))
        while size < most:
            middle = (size + most + 1) // 2
            if len((more := shared(*found[:2], middle))[0]):
                size, found = middle, more
                kept.append((size, *found[:2]))
            else:
                most = middle - 1
        places, taken = defaultdict(list), defaultdict(list)
        for j, w in zip(found[1].tolist(), found[3].tolist(), strict=True):
            places[w].append(j)
        for i, w, g in zip(found[0].tolist(), found[2].tolist(), gap[found[0]].tolist(), strict=True):
            i_free, j_free = (x + size for x in taken[g][-1]) if taken[g] else (i, 0)
            k = bisect_left(places[w], j_free)
            if i >= i_free and k < len(places[w]):
                taken[g].append((i, places[w][k]))
        for g, pairs in taken.items():
            i, i_end, j, j_end = spans[g]
            gap[i:i_end] = gap[j:j_end] = -1
            for to_i, to_j in [*pairs, (i_end, j_end)]:
                if i < to_i and j < to_j:
                    new = len(spans)
                    spans[new], gap[i:to_i], gap[j:to_j], end[i:to_i], end[j:to_j] = (i, to_i, j, to_j), new, new, to_i, to_j
                i, j = to_i + size, to_j + size
            out += [(x, y - m, size) for x, y in pairs]
        most = size - 1
    return sorted(out)


def replaced(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """(i1, i2, j1, j2) of the blocks a[i1:i2] that b[j1:j2] took the place of."""
    if max(len(a), len(b)) <= FEW:
        return [x[1:] for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] == "replace"]
    out, i, j = [], 0, 0
    for x, y, size in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x and j < y:
            out.append((i, x, j, y))
        i, j = x + size, y + size
    return out
