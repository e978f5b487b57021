"""Periodic runs of words (operator 11): bit-parallel lags over big-integer bit planes.

A text's words become numbers, and each binary digit of those numbers one big integer, a bit for each word (a
bit plane). For every lag q the planes are compared with themselves shifted by q (XOR) and the mismatches of
all planes ORed. A stretch of zeros in them is a stretch of words that equal the word q further on; AND with
its own shifts, each twice as far as the last, leaves only starts of stretches that are long enough. A run is a
stretch of words with smallest period q, of max(least, 2 q) words or more, that no neighbour extends.

Work for a text of n words is n / 2 lags of n bits each, 30 bits an instruction. Most lags end early: one plane
alone rarely leaves a long stretch, and in long texts a lag is skipped whose every q-th words all differ, since
a stretch of q equal places holds a multiple of q. A text is one row, so it is worked in one task, as a whole.

Defined results: a null or empty text, or one without words, has no runs and collapses to an empty string; texts
of any length are worked as a whole; of stretches with several periods only the smallest counts; repeated rows
are answered alike; an empty table gives an empty one; columns named runs, n_words or collapsed are replaced and
all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
#: From so many words on, a lag's multiples are looked at before its planes.
LONG_TEXT = 2048


def planes(ids: np.ndarray) -> list[int]:
    """One integer for each binary digit of ids: bit i is that digit of ids[i]."""
    top = int(ids.max(initial=0))
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(max(1, top.bit_length()))]


def starts_of(equal: int, least: int) -> int:
    """The bits of equal that begin least set bits or more in a row."""
    have = 1
    while have < least and equal:
        step = min(have, least - have)
        equal &= equal >> step
        have += step
    return equal


def stretches(starts: int) -> list[tuple[int, int]]:
    """(first, number) of the groups of set bits in a row."""
    out, at = [], 0
    while starts:
        skip = (starts & -starts).bit_length() - 1
        starts >>= skip
        n = (~starts & (starts + 1)).bit_length() - 1
        out.append((at + skip, n))
        starts >>= n
        at += skip + n
    return out


def runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ids (numbers from 0 on), by start and period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    digits = planes(ids)
    for q in range(1, n // 2 + 1):
        need = max(least - q, q)
        if q + need > n:
            break
        if n >= LONG_TEXT and need == q and not (ids[: n - q : q] == ids[q::q]).any():
            continue
        differ, left = 0, (1 << (n - q)) - 1
        for k, d in enumerate(digits):
            differ |= d ^ (d >> q)
            if k == 0 and not starts_of(left & ~differ, need):
                break
        else:
            for at, more in stretches(starts_of(left & ~differ, need)):
                found.setdefault((at, at + more - 1 + need + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words: Sequence[bytes], of: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, less those that a run has after its first period."""
    if not of:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in of:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0))


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Numbers of the words, equal for equal words, in the order in which they come."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    r"""df with n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are `[^\x20\x09-\x0D]+`, numbered from 0; least is the fewest words that a run has.
    """

    def make():
        def answer(texts: pa.Array) -> list[pa.Array]:
            counts, offsets, flat, kept = [], [0], [], []
            for t in texts.cast(pa.large_binary()).to_pylist():
                words = (t or b"").split()  # of bytes: just the six characters of white space
                one = runs(numbered(words), least) if len(words) >= 2 else []
                counts.append(len(words))
                flat += one
                offsets.append(len(flat))
                kept.append(collapse(words, one))
            columns = np.array(flat, np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], names=["start", "length", "period"])
            return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), pa.array(kept, pa.binary()).cast(pa.string())]

        return answer

    return appended(df, make, [text], [("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType())])
