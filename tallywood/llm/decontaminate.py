"""Benchmark decontamination (operator 5): BM25 over an inverted index of the test items, searched with
block-max WAND by every passage of every document, and a check of question and answer.

Terms are lower-cased runs of letters and digits. Items are numbered and put into blocks of block_items.
An item's weights are divided by what its own text scores, so an item scores 1 against a passage that
holds all its terms, and one threshold serves all. Documents are read in strides as long as the longest
item; a passage is two strides, so every run of that length lies inside a passage whole.

Beside each posting list stand its block maxima: the largest weight of the term in each block that has
it. A passage is searched only where the largest weights of its different words add up to the threshold
at all, and then only where those of some block do (array operations over the passages of a text, a
bounded number of postings at a time). Then the posting lists' cursors move: the pivot is the first item
at which the lists' largest weights add up to the threshold, blocks whose own maxima don't reach it are
jumped, and what is left is scored. Sums of bounds are compared with a margin for rounding.

Each item so found is verified: the share of its question's five-word runs, and of its answer's, that
the passage holds must be overlap or more. The answer is what follows the last question mark, or the
last sentence where there is none. A part of fewer than five words counts as one run.

The items are held in memory in shards of at most shard_chars characters; document frequencies and the
mean length are those of all items, so the result doesn't depend on the shards.

Defined results: null and empty texts match nothing, as do items without a term; an item_id or doc_id
may be null and repeated rows match each; of several passages of a document the best one is reported;
other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

K1, B = 1.2, 0.75
RUN = 5
WORD = re.compile(r"[^\W_]+")
#: Replaces all ASCII characters but letters and digits, so that plain texts are split without a pattern.
PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return text.translate(PLAIN).split() if text.isascii() else WORD.findall(text)


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    at = text.rfind("?")
    if at < 0 or not words(text[at + 1 :]):
        found = [m.end() for m in re.finditer(r"[.!?\n](?=\s)", text.rstrip()) if words(text[m.end() :])]
        at = found[-1] - 1 if found else -1
    return words(text[: at + 1]), words(text[at + 1 :])


def runs(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + RUN]) for i in range(max(1, len(w) - RUN + 1))} if w else set()


#: What sums of weights may lose to rounding.
MARGIN = 1e-9
#: Postings whose bounds are added up at once.
AT_ONCE = 1 << 20
#: A small shard's block maxima are looked up in a table of so many cells at most.
TABLE_CELLS = 1 << 20


@dataclass(eq=False)
class Index:
    """The items of one shard; lists of all terms stand one after the other, with the ends of each."""

    ids: list
    texts: list[str]
    terms: dict[str, int]
    ends: np.ndarray  # of each term's postings
    items: np.ndarray
    weights: np.ndarray
    block_ends: np.ndarray  # of each term's block maxima
    blocks: np.ndarray
    maxima: np.ndarray
    most: np.ndarray  # of each term: its largest weight
    block_items: int
    stride: int

    @classmethod
    def of(cls, items: list[tuple], n_items: int, frequency: dict[str, int], mean_words: float, stride: int, block_items: int) -> Index:
        held = sorted(((i, t, w) for i, t in items if (w := words(t))), key=lambda x: (x[2], str(x[0])))
        terms = {t: k for k, t in enumerate(sorted({w for _, _, ws in held for w in ws}))}
        at, term, weight = [], [], []
        for n, (_, _, ws) in enumerate(held):
            own = {}
            for w, f in Counter(ws).items():
                df = frequency[w]
                own[w] = np.log1p((n_items - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean_words))
            whole = sum(own.values())
            at += [n] * len(own)
            term += [terms[w] for w in own]
            weight += [x / whole for x in own.values()]
        at, term, weight = np.array(at, np.int64), np.array(term, np.int64), np.array(weight, np.float64)
        order = np.argsort(term, kind="stable")
        at, term, weight = at[order], term[order], weight[order]
        ends = np.searchsorted(term, np.arange(len(terms)), side="right")
        block = at // block_items
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(at) else np.zeros(0, np.int64)
        maxima = np.maximum.reduceat(weight, first) if len(at) else weight
        block_ends = np.searchsorted(term[first], np.arange(len(terms)), side="right")
        most = np.maximum.reduceat(maxima, np.concatenate([[0], block_ends[:-1]])) if len(at) else weight
        return cls([i for i, _, _ in held], [t for _, t, _ in held], terms, ends, at, weight, block_ends, block[first], maxima, most, block_items, stride)

    @lru_cache(maxsize=4096)  # noqa: B019  an index lives as long as its worker
    def runs_of(self, item: int) -> tuple[frozenset, frozenset]:
        """The runs of an item's question and answer."""
        q, a = parts(self.texts[item])
        return frozenset(runs(q)), frozenset(runs(a))

    def wand(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score threshold or more for the terms query."""
        least = threshold - MARGIN
        lists = []  # items, weights, cursor, largest weight, blocks, their maxima
        for t in query:
            a, b = (self.ends[t - 1] if t else 0), self.ends[t]
            c, d = (self.block_ends[t - 1] if t else 0), self.block_ends[t]
            lists.append([self.items[a:b], self.weights[a:b], 0, float(self.most[t]), self.blocks[c:d], self.maxima[c:d]])
        found = []
        while lists:
            lists.sort(key=lambda c: c[0][c[2]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
                pivot += 1
            block, bound = item // self.block_items, 0.0
            for c in lists[: pivot + 1]:
                k = int(np.searchsorted(c[4], block))
                if k < len(c[4]) and c[4][k] == block:
                    bound += c[5][k]
            if bound < least:
                # no item of this block, nor any before the next list's place, can reach the threshold
                to = (block + 1) * self.block_items
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][2]])
            else:
                to = item
                if lists[0][0][lists[0][2]] == item:
                    score = sum(c[1][c[2]] for c in lists if c[0][c[2]] == item)
                    if score >= least:
                        found.append((int(item), float(score)))
                    to = item + 1
            for c in lists[: pivot + 1]:
                c[2] = int(np.searchsorted(c[0], to)) if c[0][c[2]] < to else c[2]
            lists = [c for c in lists if c[2] < len(c[0])]
        return found

    def table(self, n_blocks: int) -> np.ndarray | None:
        """The block maxima as a table (terms, blocks), if that has TABLE_CELLS cells at most."""
        if "_table" not in self.__dict__:
            self._table = None
            if len(self.terms) * n_blocks <= TABLE_CELLS:
                self._table = np.zeros((len(self.terms), n_blocks))
                self._table[np.repeat(np.arange(len(self.terms)), np.diff(self.block_ends, prepend=0)), self.blocks] = self.maxima
        return self._table

    def candidates(self, w: list[str], threshold: float) -> Iterator[tuple[int, int]]:
        """(first word, end) of each passage for which some block's maxima add up to threshold."""
        at, ids = self._known(w)
        if not len(ids):
            return
        first, size, least = at // self.stride, len(self.terms), threshold - MARGIN
        # passage k is strides k and k + 1; a term counts once in a passage
        key = np.unique(np.concatenate([first * size + ids, (first[first > 0] - 1) * size + ids[first > 0]]))
        passage, ids = key // size, key % size
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        nth = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(ids)]])))
        fits = (np.add.reduceat(self.most[ids], begin) >= least)[nth]
        passage, ids = passage[fits], ids[fits]
        if not len(ids):
            return
        n_blocks = int(self.blocks.max()) + 1
        table = self.table(n_blocks)
        low = np.where(ids > 0, self.block_ends[ids - 1], 0)
        count = self.block_ends[ids] - low if table is None else np.full(len(ids), n_blocks)
        begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        upto = np.cumsum(count)
        lo = 0
        while lo < len(begin):  # whole passages, as many as have AT_ONCE postings together, one at least
            before = upto[begin[lo] - 1] if begin[lo] else 0
            hi = max(lo + 1, int(np.searchsorted(upto[np.append(begin[1:], len(ids)) - 1], before + AT_ONCE, side="right")))
            a, b = begin[lo], begin[hi] if hi < len(begin) else len(ids)
            n = count[a:b]
            if table is not None:
                sums = np.add.reduceat(table[ids[a:b]], begin[lo:hi] - a, axis=0)
                for k in passage[begin[lo:hi][sums.max(axis=1) >= least]].tolist():
                    yield k * self.stride, min(len(w), (k + 2) * self.stride)
                lo = hi
                continue
            flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
            own = np.repeat(passage[a:b], n) * n_blocks + self.blocks[flat]
            where, to = np.unique(own, return_inverse=True)
            sums = np.bincount(to, weights=self.maxima[flat])
            for k in np.unique(where[sums >= least] // n_blocks).tolist():
                yield k * self.stride, min(len(w), (k + 2) * self.stride)
            lo = hi

    def _known(self, w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the words that some item has."""
        ids = np.fromiter(map(self.terms.get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        return at, ids[at]

    def matches(self, text: str | None, threshold: float, overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """For each item found: score, shares of question and answer, and the passage's first word."""
        w = words(text)
        best: dict[int, tuple[float, float, float, int]] = {}
        for a, b in self.candidates(w, threshold):
            passage = w[a:b]
            query = sorted({k for x in passage if (k := self.terms.get(x)) is not None})
            found = self.wand(query, threshold)
            if not found:
                continue
            held = runs(passage)
            plain = set(zip(passage)) if any(len(r) < RUN for i, _ in found for part in self.runs_of(i) for r in part) else set()
            for i, score in found:
                shares = []
                for part in self.runs_of(i):
                    hits = sum(r in held if len(r) == RUN else _holds(passage, r, plain) for r in part)
                    shares.append(hits / len(part) if part else 1.0)
                if min(shares) >= overlap and (i not in best or (score, *shares, -a) > (*best[i][:3], -best[i][3])):
                    best[i] = (score, *shares, a)
        return best


def _holds(passage: list[str], run: tuple[str, ...], single: set) -> bool:
    n = len(run)
    return all((x,) in single for x in run) and any(tuple(passage[i : i + n]) == run for i in range(len(passage) - n + 1))


def shards(items: DataFrame, item_id: str, item_text: str, block_items: int, shard_chars: int) -> Iterator[Broadcast]:
    """The index of each shard, shared with the tasks; a shard holds about shard_chars characters."""
    spark = items.sparkSession
    tests = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t"))
    listed = tests.mapInArrow(_item_words, "terms array<string>, n long")
    total = listed.filter("n > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    size = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // shard_chars))
    frequency = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for s in range(n):
        held = [(r.item, r.t) for r in tests.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == s).collect()]  # shard_chars characters or so
        if n == 1:
            df = {r.term: r.df for r in frequency.collect()}
        else:
            own = spark.createDataFrame([(w,) for w in sorted({w for _, t in held for w in words(t)})], "term string")
            df = {r.term: r.df for r in frequency.join(own, "term", "left_semi").collect()}
        yield spark.sparkContext.broadcast(Index.of(held, total.n, df, total.mean or 1.0, int(total.longest or 1), block_items))


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.6, block_items: int = 2, shard_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of each document and item that match.

    The documents are read once for each shard of the items.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for shared in shards(items, item_id, item_text, block_items, shard_chars):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for b in (part for batch in batches for part in sliced(batch, [1])):
                got = [(d, index.ids[i], *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, m in index.matches(t.as_py(), threshold, overlap).items()]
                if got:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = rows.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        out = found if out is None else out.unionAll(found)
    return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = [words(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sorted(set(x)) for x in w], pa.list_(pa.string())), pa.array([len(x) for x in w], pa.int64())], names=["terms", "n"])


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.6, block_items: int = 2, shard_chars: int = 4 << 20) -> DataFrame:
    """The rows of docs that match no item, each judged where it stands: no row is shuffled.

    What a shard of the items leaves goes through the next one in the same pass over docs.
    """
    left = docs
    for shared in shards(items, item_id, item_text, block_items, shard_chars):
        where = left.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, where=where) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for b in (part for batch in batches for part in sliced(batch, [where])):
                clean = [not index.matches(t.as_py(), threshold, overlap) for t in b.column(where)]
                yield b.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(keep, left.schema)
    return left
