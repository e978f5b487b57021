"""Common blocks against difflib's, and that a large file of repeated lines is no matter of hours."""

import difflib
import random
import time

from tallywood.operators import alignment as A


def wanted(a, b):
    return [x[1:] for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] == "replace"]


def edited(a, r, times, words):
    b = list(a)
    for _ in range(times):
        i, how = r.randrange(len(b) + 1), r.randrange(4)
        if how == 0:
            del b[i : i + r.randint(0, 5)]
        elif how == 1:
            b[i:i] = [str(r.randrange(words)) for _ in range(r.randint(0, 4))]
        elif how == 2:
            b[i : i + 1] = [str(r.randrange(words))]
        else:
            b[i:i] = b[: r.randint(0, 10)]
    return b


def test_blocks_are_those_of_difflib():
    r = random.Random(5)
    for _ in range(3000):
        words = r.choice([1, 2, 3, 5, 20, 200])
        a = [str(r.randrange(words)) for _ in range(r.randint(0, 50))]
        b = edited(a, r, r.randint(0, 12), words) if r.random() < 0.6 else [str(r.randrange(words)) for _ in range(r.randint(0, 50))]
        joined = []
        for i, j, n in A.blocks(a, b):
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
            joined.append((i, j, n))
        assert joined == [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]], (a, b)


def test_replaced_beyond_what_difflib_is_asked_for():
    r = random.Random(6)
    for words in (1, 3, 40, 10**9):
        a = [str(r.randrange(words)) for _ in range(3 * A.FEW)]
        b = edited(a, r, 60, words)
        assert A.replaced(a, b) == wanted(a, b)


def regular(n):
    r = random.Random(7)
    a = ["" if r.random() < 0.4 else f"x{r.randrange(50)}" for _ in range(n)]
    return a, [f"y{i}" if i % 10 == 0 else x for i, x in enumerate(a)]


def test_a_large_file_whose_lines_repeat():
    a, b = regular(1200)
    assert A.replaced(a, b) == wanted(a, b)
    a, b = regular(60_000)
    began, found = time.process_time(), A.blocks(a, b)
    assert time.process_time() - began < 60
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
    assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(found, found[1:], strict=False))
    assert sum(n for *_, n in found) > 0.89 * len(a)
