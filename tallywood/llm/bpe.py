"""Byte-level BPE encoding and decoding (operator 1).

Each match of the split pattern is merged on its own. The pairs that can merge wait in buckets, one
per merge rank, which hold positions of a linked list of parts; a three-level bitmap over the ranks
finds the first bucket that isn't empty by find-first-set. An entry whose part has gone or whose pair
has changed meanwhile is stale and skipped. All new pre-tokens of a batch stand in one list, with no
link from one to the next, so a bucket is merged by a few array operations; a pre-token of n bytes
takes n pushes and pops, however long it is.

A merge may only be put off past one of a higher rank if no pair of lower rank arises from it. Where
one does, which trained ranks hardly ever show, the pre-token is done again position by position.

Nulls count as empty texts: no ids. Repeated rows are encoded alike; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

#: Entries a worker keeps of pieces and pre-tokens seen before; beyond them the later half goes.
CACHE_ENTRIES = 220_000
#: Longer pieces aren't kept.
CACHE_CHARS = 64
#: All that any of the libraries takes for white space, and some more: a blank beside these is no plain word break.
BROAD_SPACE = frozenset(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))

#: Split patterns (fixed values) by which a blank between two characters that aren't white space always begins a match.
BLANK_BEGINS = frozenset([r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""])


def uneven(head: str) -> bool:
    """Whether white space ends the part of a text before its first blank."""
    return head != "" and head[-1] in BROAD_SPACE


def uneven_inside(piece: str) -> bool:
    """Whether white space begins or ends what stands after a blank."""
    return piece == "" or piece[0] in BROAD_SPACE or piece[-1] in BROAD_SPACE


class RankQueue:
    """Entries by merge rank, the lowest rank first; add and take are those of the buckets."""

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [entry]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(entry)

    def first(self) -> int:
        """The lowest rank with entries, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        x = self.mid[b]
        a = (b << 6) | ((x & -x).bit_length() - 1)
        x = self.low[a]
        return (a << 6) | ((x & -x).bit_length() - 1)

    def take(self, rank: int) -> list:
        """All entries of a rank; they leave the queue."""
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Ranks and split pattern, with what this process has encoded lately."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.by_blanks = pattern in BLANK_BEGINS
        n = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(n)
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        halves = (x for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks for x in (ranks[t[:k]], ranks[t[k:]], r))
        a, b, r = np.fromiter(halves, np.int64).reshape(-1, 3).T
        order = np.argsort(a << 32 | b)
        self.pair_key, self.pair_rank = (a << 32 | b)[order], r[order]
        self.pre: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which tokens a and b merge, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, one merge after the other."""
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [-1] * n

        def look(i: int) -> None:
            """Enters the pair that begins at i."""
            r = ranks.get(piece[i : end[after[i]]], -1) if after[i] < n else -1
            pair[i] = r
            if r >= 0:
                queue.push(r, i)

        for i in range(n):
            look(i)
        while (r := queue.first()) >= 0:
            waiting = [i for i in queue.take(r) if pair[i] == r]
            heapq.heapify(waiting)
            while waiting:
                i = heapq.heappop(waiting)
                if pair[i] != r:
                    continue
                j = after[i]
                after[i], end[i], pair[j] = after[j], end[j], -1
                if after[i] < n:
                    before[after[i]] = i
                look(i)
                if before[i] >= 0:
                    look(before[i])
                if 0 <= queue.first() < r:  # a lower rank has arisen: the rest waits
                    for i in waiting:
                        queue.push(r, i)
                    break
                if r in queue.buckets:
                    for i in queue.take(r):
                        heapq.heappush(waiting, i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as packed 32-bit integers."""
        if not pieces:
            return []
        queue = self.queue
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        token = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1, np.int64)
        odd: list[np.ndarray] = []

        def enter(at: np.ndarray, floor: int) -> None:
            """Enters the pairs that begin at the sorted positions at; those under floor are noted."""
            to = after[at]
            r = np.where(to >= 0, self.pair(token[at], token[to]), -1)
            pair[at] = r
            fits = r >= 0
            at, r = at[fits], r[fits]
            if not len(at):
                return
            if (r < floor).any():
                odd.append(at[r < floor])
            if len(at) == 1:
                queue.push(int(r[0]), at)
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, a, b in zip(r[np.concatenate([[0], cut])].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                queue.push(rank, at[a:b])

        enter(np.arange(n), 0)
        while (rank := queue.first()) >= 0:
            got = queue.take(rank)
            at = got[0] if len(got) == 1 else np.unique(np.concatenate(got))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1 and (meets := after[at[:-1]] == at[1:]).any():
                # of pairs that share parts the first, third, ... of each run merge
                begin = np.concatenate([[True], ~meets])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            gone = after[at]
            to = after[gone]
            if (to[:-1] == at[1:]).any():
                # merged from left to right, a pair meets what follows before that is merged itself
                passing = self.pair(np.int64(rank), token[to[:-1]])
                if (under := (passing >= 0) & (passing < rank)).any():
                    odd.append(at[:-1][under])
            token[at] = rank
            after[at] = to
            alive[gone] = False
            pair[gone] = -1
            inner = to >= 0
            before[to[inner]] = at[inner]
            left = before[at]
            left = left[left >= 0]
            both = np.concatenate([at, left])
            enter(np.unique(both) if len(both) > 1 else both, rank)
        word = np.repeat(np.arange(len(pieces)), sizes)
        counts = np.bincount(word[alive], minlength=len(pieces))
        packed = token[alive].astype(np.int32).tobytes()
        stops = (np.cumsum(counts) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        for i in np.unique(word[np.concatenate(odd)]).tolist() if odd else []:
            out[i] = np.array(self.merge(pieces[i]), np.int32).tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers.

        By the patterns BLANK_BEGINS a blank between two characters that aren't white space begins a
        match. Texts where all blanks do are taken apart there, and each piece is looked up whole; by
        other patterns every text is split whole.
        """
        pre, known = self.pre, self.after_blank
        for cache in (known, pre):
            if len(cache) > CACHE_ENTRIES:  # the commonest entries came first
                early = dict(islice(cache.items(), CACHE_ENTRIES // 2))
                cache.clear()
                cache.update(early)
        new: set[str] = set()
        matches: dict[int, list[str]] = {}
        whole: set[int] = set()
        for i, t in enumerate(texts):
            if not self.by_blanks:
                whole.add(i)
                matches[i] = self.split(t)
                continue
            head, *rest = t.split(" ")
            more = set(rest).difference(known)
            if uneven(head if rest else "") or any(map(uneven_inside, more)):
                whole.add(i)
                matches[i] = self.split(t)
            else:
                matches[i] = self.split(head)
                new |= more
        parts = {x: self.split(" " + x) for x in new}
        missing = {m for x in (matches, parts) for ms in x.values() for m in ms if m not in pre}
        pieces, merged = [], []
        for m in missing:
            b = m.encode()
            if (r := self.ranks.get(b)) is not None:
                pre[m] = r.to_bytes(4, "little")
            else:
                pieces.append(b)
                merged.append(m)
        pre.update(zip(merged, self.merge_all(pieces), strict=True))
        for x, ms in parts.items():
            known[x] = b"".join(map(pre.__getitem__, ms))
        out = []
        for i, t in enumerate(texts):
            ids = b"".join(map(pre.__getitem__, matches[i]))
            out.append(ids if i in whole else ids + b"".join(map(known.__getitem__, t.split(" ")[1:])))
        for m in missing:
            if len(m) > CACHE_CHARS:
                del pre[m]
        for x in new:
            if len(x) > CACHE_CHARS:
                del known[x]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


def decoded(ids: np.ndarray, of: list[bytes]) -> bytes:
    return b"".join(map(of.__getitem__, ids.tolist()))


def as_lists(parts: list[bytes]) -> pa.Array:
    """A list array from the packed 32-bit integers of each row."""
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    values = pa.array(np.frombuffer(b"".join(parts), np.int32))
    if ends[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    return pa.LargeListArray.from_arrays(pa.array(ends), values)


def decoded_lists(lists: pa.Array, of: list[bytes]) -> pa.Array:
    """The bytes of each row's ids; none for a null."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.array([decoded(flat[a:b], of) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the array<int> column out: the ids of the column text. Null texts get an empty array."""

    def make():
        c = codec(ranks_path, pattern)
        return lambda texts: [as_lists(c.encode_all([t or "" for t in texts.to_pylist()]))]

    return appended(df, make, [text], [(out, T.ArrayType(T.IntegerType()))])


def bpe_decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the binary column out: the bytes of the ids. A null array gives no bytes."""

    def make():
        of = vocabulary(ranks_path)
        return lambda lists: [decoded_lists(lists, of)]

    return appended(df, make, [ids], [(out, T.BinaryType())])


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with both columns: the ids of the column text, and the bytes of those ids. One Python worker a task does both."""

    def make():
        c, of = codec(ranks_path, pattern), vocabulary(ranks_path)

        def f(texts: pa.Array) -> list[pa.Array]:
            lists = as_lists(c.encode_all([t or "" for t in texts.to_pylist()]))
            return [lists, decoded_lists(lists, of)]

        return f

    return appended(df, make, [text], [(ids, T.ArrayType(T.IntegerType())), (out, T.BinaryType())])
