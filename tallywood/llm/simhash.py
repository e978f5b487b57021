"""SimHash near-dedup with a Gray-order hierarchical index (operator 9).

Fingerprints: words are runs of bytes other than ASCII white space, after A-Z are lower-cased; each
run of four words gives an XXH64 (seed 42); a fingerprint bit is set if it is set in over half of them.

Links join fingerprints at max_distance or fewer differing bits. Two fingerprints that differ in four
bits agree on one of five bit segments at least, so each distinct fingerprint goes to five groups, one
for each segment with its value, and all links lie inside groups. A group of more than group_rows is
split into chunks, and every pair of chunks is a group of its own: no group grows without bound and no
pair is lost. Within a group the fingerprints are sorted by Gray rank and indexed by a tree: a node
holds the bits that all fingerprints below share, less those its parent holds. A search carries the
differences met so far and drops a node as soon as they exceed max_distance; where the bits that are
left free can't exceed it, all below the node link without being looked at.

A group gives a star for each set of linked fingerprints instead of all their pairs. Components of the
stars are found by joins. Copies share one fingerprint and are never paired. Groups are sorted by Spark and
searched one after the other; no task holds more than a few groups.

similar_components links by similarity instead: texts whose sets of width-word shingles share at least share of
their union. Fingerprints of 64 bits tell that only roughly (0.8 is some ten bits away, and as many as 20), too far
for bit segments, so the groups are made otherwise: a text goes to those of its anchors, the smallest hashes
of its set, of which two such sets nearly always have one in common. Within the groups the same index
finds all pairs within wide bits, and each is confirmed on the whole sets. An anchor that more than frequent
texts have (a passage that many share, a large group of copies) is passed over for the next smallest. A text that
so has fewer than anchors of them, as in a large group of near copies, is held against one text of each common anchor, round after
round with what isn't linked yet, while a round still adds a share of 1 / worth to the links (two rounds at least): rounds only save work. Such texts are also found exactly among each other:
their whole sets are ordered from the rarest shingle on, and two that share enough have a common one among the first fifth and one more. Those
that frequent of them or fewer have make groups as anchors do, all of them; by those that more have, every text outside the largest
component of the shingle is held against all texts of other components, over chunks, after the rounds. Copies of one component are never paired there,
and of the rest only pairs leave the task whose shingles, counted in BUCKETS by hash, differ so little that they can share enough: such counts never differ
by more than the sets do, so no link is lost by them.

Defined results: a null text counts as empty; no words give fingerprint zero, linked like any other;
rows without doc_id carry no links and get the component of their fingerprint (null if no row with a
doc_id has it); repeated rows are in one component; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, cut, free, fresh_path, removed, small
from .graph import components

FAN = 16
#: Counts by which two sets are told apart without their shingles.
BUCKETS = 256


def fingerprint(text: bytes, width: int = 4) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    of, n = xxhash.xxh64_intdigest, len(starts)
    h = np.fromiter([of(flat[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(h[at : at + 65_536].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def simhash(df: DataFrame, text: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """df with the long column out: the 64 bits of the text's fingerprint."""

    def make():
        def f(texts: pa.Array) -> list[pa.Array]:
            raw = texts.cast(pa.large_binary())
            return [pa.array(np.array([fingerprint(t.as_py() or b"", width) for t in raw], np.uint64).view(np.int64), pa.int64())]

        return f

    return appended(df, make, [text], [(out, T.LongType())])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each code stands in the order of reflected Gray codes."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): first[i], first[i] + 1, ... count[i] of them, for each row i."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def searched(codes: np.ndarray, group: np.ndarray, most: int, block: int, every: bool) -> np.ndarray:
    """For codes sorted by (group, Gray rank): links (2, n) between indexes; with every all pairs within most, else enough
    of them to hold each set of linked codes together."""
    n = len(codes)
    if n < 2:
        return np.zeros((2, 0), np.int64)
    # levels[0] is the leaves; a level holds AND and OR of the codes below, first child, children, first and last leaf
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    one = np.ones(n, np.int64)
    levels = [(codes, codes, np.arange(n), one, np.arange(n), np.arange(n) + 1)]
    sizes = np.diff(np.concatenate([starts, [n]]))
    while len(levels) < 2 or sizes.max() > 1:
        up = -(-sizes // FAN)
        at = np.cumsum(sizes) - sizes
        g, nth = _spread(np.zeros(len(up), np.int64), up)
        first = at[g] + nth * FAN
        count = np.minimum(FAN, sizes[g] - nth * FAN)
        low, high, _, _, lo, hi = levels[-1]
        levels.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), first, count, lo[first], hi[first + count - 1]))
        sizes = up
    masks = [~(x[0] ^ x[1]) for x in levels]  # bits that all below share
    ends: list[np.ndarray] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            ends.append(np.stack([a, b]))

    close = [np.bitwise_count(~m) <= most for m in masks]  # any two below link
    for k in range(1, 0 if every else len(levels)):
        under = np.flatnonzero(close[k])
        row, leaf = _spread(levels[k][4][under], levels[k][5][under] - levels[k][4][under])
        keep(leaf, levels[k][4][under][row])
    root_of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [n]])))
    for at in range(0, n, block):
        q = np.arange(at, min(n, at + block))
        node = root_of[q]
        top = len(levels) - 1
        acc = np.bitwise_count((codes[q] ^ levels[top][0][node]) & masks[top][node]).astype(np.int64)
        for k in range(top, 0, -1):
            fits = (acc <= most) & (levels[k][5][node] > q + 1)
            q, node, acc = q[fits], node[fits], acc[fits]
            whole = acc + np.bitwise_count(~masks[k][node]) <= most
            if every:
                whole[:] = False
            whole &= levels[k][4][node] > q
            # all below link with each other too, so one link into the node is enough
            keep(q[whole], levels[k][4][node[whole]])
            q, node, acc = q[~whole], node[~whole], acc[~whole]
            row, child = _spread(levels[k][2][node], levels[k][3][node])
            q, acc = q[row], acc[row]
            fresh = masks[k - 1][child] & ~masks[k][node][row]
            acc = acc + np.bitwise_count((codes[q] ^ levels[k - 1][0][child]) & fresh)
            node = child
        fits = (acc <= most) & (node > q)
        keep(q[fits], node[fits])
    return np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)


def linked(codes: np.ndarray, group: np.ndarray, most: int, block: int = 8192) -> np.ndarray:
    """For codes sorted by (group, Gray rank): for each, the index of its star's centre within its group."""
    a, b = searched(codes, group, most, block, every=False)
    label = np.arange(len(codes))
    while True:  # the smallest label spreads along the links
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, old):
            return label


def by_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups, about rows rows at a time, of batches sorted by their first columns, keys of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(size, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield [c.to_numpy() for c in t.slice(0, last).columns]
        held = t.slice(last).to_batches()
        size -= last
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).combine_chunks().columns]


def segment_keys(segments: int, most: int) -> list[list[tuple[int, int]]]:
    """For each choice of segments - most segments: (first bit, bits) of its segments."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    spans = [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [list(c) for c in combinations(spans, segments - most)]


def near_links(nodes: DataFrame, max_distance: int = 4, segments: int | None = None, group_rows: int = 50_000) -> DataFrame:
    """(a, b): links whose components are those of all pairs within max_distance.

    nodes: (node long, fp long), one row for each distinct fp. By default there are as few segments, five or more, as
    keep the mean group within group_rows: a group holds one 8192nd of the fingerprints with five of them,
    a 2,000,000th with six.
    """
    if segments is None:
        n, segments = nodes.count(), max_distance + 1
        while n >> (64 * (segments - max_distance) // segments) > group_rows and len(segment_keys(segments + 1, max_distance)) <= 120:
            segments += 1
    choices = segment_keys(segments, max_distance)
    if max(sum(w for _, w in c) for c in choices) > 55 or len(choices) > 120:
        raise ValueError("segments: too many for the key")

    def key(i: int, spans: list[tuple[int, int]]):
        value = F.lit(i).cast("long")
        for at, width in spans:
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1))
        return value

    keyed = nodes.select("node", "fp", F.explode(F.array(*[key(i, c) for i, c in enumerate(choices)])).alias("key"))
    # one row for a group beyond group_rows: the table of them is smaller by that factor
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select("key", F.ceil(F.col("n") / group_rows).cast("int").alias("chunks"))
    keyed = keyed.join(large, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda j: F.least(mine, j).cast("long") * 1_000_000 + F.greatest(mine, j))
    )
    keyed = keyed.select("key", F.explode(pairs).alias("pair"), "node", "fp").repartition("key", "pair").sortWithinPartitions("key", "pair")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, pair, node, fp in by_groups(batches, 2):
            fp = fp.view(np.uint64)
            order = np.lexsort((gray_rank(fp), pair, k))
            node, fp, k, pair = node[order], fp[order], k[order], pair[order]
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (pair[1:] != pair[:-1]))])
            label = linked(fp, group, max_distance)
            on = np.flatnonzero(label != np.arange(len(label)))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[label[on]])], names=["a", "b"])

    return keyed.mapInArrow(stars, "a long, b long").distinct()


def simhash_components(df: DataFrame, id: str = "doc_id", text: str = "text", max_distance: int = 4, segments: int | None = None, width: int = 4) -> DataFrame:
    """(id, fp long, component_id) for each row of df."""
    docs = cut(simhash(df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), width=width).select("id", "fp"))
    nodes = docs.groupBy("fp").agg(F.min("id").alias("node"))
    links = near_links(nodes.filter("node IS NOT NULL").select("node", "fp"), max_distance, segments)
    found = components(links)
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return docs.join(of, "fp").select(F.col("id").alias(id), "fp", "component_id")


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of the runs of width words, in order; of all words where they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    return np.unique(np.fromiter([of(flat[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def bucket_counts(h: np.ndarray) -> bytes:
    """How many of the hashes fall in each of BUCKETS, 255 at most."""
    return np.minimum(np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def may_share(n: np.ndarray, counts: np.ndarray, component: np.ndarray, x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes of y) of pairs of other components whose sets can share enough, by their sizes n and their counts.

    Two sets that share enough differ by (1 - share) / (1 + share) of their sizes together at most, and counts that are null (all zero) by nothing.
    """
    less, of = share
    y = y[np.argsort(n[y], kind="stable")]
    told = counts.any(axis=1)
    for i in x:
        lo, hi = np.searchsorted(n[y], -(-n[i] * less // of)), np.searchsorted(n[y], n[i] * of // less, side="right")
        near = y[lo:hi]
        near = near[component[near] != component[i]]
        for at in range(0, len(near), 4096):
            part = near[at : at + 4096]
            apart = np.abs(counts[part].astype(np.int16) - counts[i]).sum(axis=1, dtype=np.int64)
            part = part[(apart * (of + less) <= (n[part] + n[i]) * (of - less)) | ~told[part] | ~told[i]]
            if len(part):
                yield int(i), part


def similar_components(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (4, 5), wide: int = 24, anchors: int = 4, depth: int = 16, frequent: int = 100, chunk: int = 2000, worth: int = 20) -> DataFrame:
    """(id, component_id) for each row of df: components of texts that share share (a fraction, as a pair of integers) of their shingles."""
    raw = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def sketch():
        def f(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(t.as_py() or b"", width) for t in texts.cast(pa.large_binary())]
            digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            fp = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            return [pa.array(digest, pa.binary()), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array([x[:depth].view(np.int64) for x in sets], pa.list_(pa.int64()))]

        return f

    adds = [("digest", T.BinaryType()), ("fp", T.LongType()), ("n", T.IntegerType()), ("low", T.ArrayType(T.LongType()))]
    docs = cut(appended(raw, sketch, ["text"], adds).select("id", "digest", "fp", "n", "low"))
    # texts with equal sets are one node, named by the smallest id
    nodes = cut(docs.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("low").alias("low")))

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, s): the whole sets of some rows, from their texts."""

        def whole():
            def f(texts: pa.Array) -> list[pa.Array]:
                sets = [shingles(t.as_py() or b"", width) for t in texts.cast(pa.large_binary())]
                return [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(list(map(bucket_counts, sets)), pa.binary())]

            return f

        return appended(raw.join(small(ids), "id", "left_semi"), whole, ["text"], [("s", T.ArrayType(T.LongType())), ("counts", T.BinaryType())]).select("id", "s", "counts")

    held = nodes.select("node", F.explode("low").alias("key"))
    counts = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > frequent).select("key"))
    none = F.array().cast("array<bigint>")
    if counts.limit(1).count():
        passed = held.join(small(counts), "key").groupBy("node").agg(F.collect_set("key").alias("common"))
        marked = nodes.select("node", "fp", "n", "low").join(passed, "node", "left")
        common = F.coalesce("common", none)
        rare = F.slice(F.array_except("low", common), 1, anchors)
        marked = marked.select("node", "fp", "n", rare.alias("rare"), F.slice(F.array_intersect("low", common), 1, F.greatest(anchors - F.size(rare), F.lit(0))).alias("common"))
        marked = cut(marked)
        # what sets a member of a large group apart are the shingles that its base doesn't have, wherever they stand
        few = cut(marked.filter(F.size("common") > 0).select(F.col("node").alias("id")))
        spelled = cut(sets_of(few).withColumnRenamed("id", "node"))
        # rows that share an id have no counts of their own
        counted = spelled.groupBy("node").agg(F.nullif(F.min("counts"), F.when(F.min("counts") != F.max("counts"), F.min("counts"))).alias("counts"))
        own = cut(spelled.select("node", F.explode("s").alias("key")).distinct())
        spread = own.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        # of two sets that share enough, each has one of the common hashes among its first, from the rarest on: n less share of n, and one
        own = own.join(spread, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("w"))
        own = own.withColumn("w", F.expr(f"slice(w, 1, CAST(size(w) * {share[1] - share[0]} DIV {share[1]} AS INT) + 1)"))
        own = own.select("node", F.filter("w", lambda x: (x["c"] > 1) & (x["c"] <= frequent))["key"].alias("deep"), F.filter("w", lambda x: x["c"] > frequent)["key"].alias("often"))
        marked = marked.join(own, "node", "left").withColumn("rare", F.array_union("rare", F.coalesce("deep", none))).drop("deep")
        marked = cut(marked.withColumn("often", F.coalesce("often", none)).join(counted, "node", "left"))
    else:
        marked = nodes.select("node", "fp", "n", F.slice("low", 1, anchors).alias("rare"), none.alias("common"), none.alias("often"), F.lit(None).cast("binary").alias("counts"))

    groups = marked.select(F.explode("rare").alias("key"), "node", "fp", "n").repartition("key").sortWithinPartitions("key")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp, n in by_groups(batches, 1):
            twin = key[1:] == key[:-1]
            shared = np.append(twin, False) | np.append(False, twin)
            key, node, fp, n = key[shared], node[shared], fp[shared].view(np.uint64), n[shared].astype(np.int64)
            order = np.lexsort((gray_rank(fp), key))
            key, node, fp, n = key[order], node[order], fp[order], n[order]
            a, b = searched(fp, np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]), wide, 8192, every=True)
            fits = (np.minimum(n[a], n[b]) * share[1] >= np.maximum(n[a], n[b]) * share[0]) & (node[a] != node[b])
            if fits.any():
                x, y = node[a[fits]], node[b[fits]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def confirmed(candidates: DataFrame) -> DataFrame:
        """The candidates (a, b) whose whole sets share enough, from the texts."""
        spark, folder = df.sparkSession, fresh_path(df.sparkSession, "confirmed")
        candidates = cut(candidates.distinct(), folder)
        ends = cut(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), folder)

        sets = cut(sets_of(ends).select("id", "s").distinct(), folder)
        x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        ok = both * share[1] >= (F.size("x") + F.size("y") - both) * share[0]
        found = cut(candidates.join(x, "a").join(y, "b").filter(ok).select("a", "b").distinct())
        removed(spark, folder)
        return found

    links = confirmed(groups.mapInArrow(near, "a long, b long"))
    rest = cut(marked.select(F.explode("common").alias("key"), "node", "fp", "n"))
    labels, turn = components(links), 0
    while rest.limit(1).count():
        tagged = cut(rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        # one text of each key against the others that aren't in its component; a key whose texts all are in one is done
        # by turns the one with the smallest id and the one with the smallest set, which a common passage may make up whole
        first = cut(tagged.groupBy("key").agg(F.min(F.struct(*(["node", "n"] if turn % 2 == 0 else ["n", "node"]), "fp", "component")).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi"))
        x = first.select("key", F.col("m.node").alias("a"), F.col("m.fp").alias("af"), F.col("m.n").alias("an"), F.col("m.component").alias("ac"))
        y = tagged.select("key", F.col("node").alias("b"), F.col("fp").alias("bf"), F.col("n").alias("bn"), F.col("component").alias("bc"))
        other = y.join(small(cut(x)), "key").filter(F.col("ac") != F.col("bc"))
        fits = (F.least("an", "bn") * share[1] >= F.greatest("an", "bn") * share[0]) & (F.bit_count(F.col("af").bitwiseXOR(F.col("bf"))) <= wide)
        new = confirmed(other.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        turn, more, were = turn + 1, new.count(), links.count()
        if more:
            links = cut(links.unionByName(new))
            labels = components(links)
        if turn > 1 and more * worth <= were:
            break
        rest = cut(other.select("key", F.col("b").alias("node"), F.col("bf").alias("fp"), F.col("bn").alias("n")))
    # what the rounds have left apart: by each common hash, all that aren't in its largest component against all of other components
    held = cut(marked.filter(F.size("often") > 0).select(F.explode("often").alias("key"), "node", "n", "counts").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    most = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("apart"), F.sum("c").alias("c"), F.max("c").alias("in_most"))
    pieces = lambda c: F.greatest(F.ceil(c / chunk), F.lit(1)).cast("int")
    most = cut(most.filter("apart > 1").select("key", "most", pieces(F.col("c") - F.col("in_most")).alias("outer"), pieces(F.col("c")).alias("chunks")))
    if most.limit(1).count():
        held = held.join(small(most), "key").withColumn("out", F.col("component") != F.col("most"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        rows = [F.col("node"), F.col("n").cast("long").alias("n"), F.col("component"), F.col("out"), F.coalesce("counts", F.unhex(F.lit("00" * BUCKETS))).alias("counts")]
        x = held.filter("out").select("key", every("chunks").alias("chunk"), mine("outer").alias("piece"), F.lit(True).alias("left"), *rows)
        y = held.select("key", mine("chunks").alias("chunk"), every("outer").alias("piece"), F.lit(False).alias("left"), *rows)

        def near_outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, part, piece, left, node, n, component, out, counts in by_groups(batches, 3, 4 * chunk):
                starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (piece[1:] != piece[:-1]), [True]]))
                counts = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, BUCKETS)
                for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                    at = np.arange(lo, hi)
                    # two that both lie outside meet twice: one of the two is enough
                    found = [(node[i], v) for i, js in may_share(n, counts, component, at[left[lo:hi]], at[~left[lo:hi]], share) for v in node[js[~out[js] | (node[js] > node[i])]]]
                    if found:
                        a, b = np.array(found, np.int64).T
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        met = x.unionAll(y).repartition("key", "chunk", "piece").sortWithinPartitions("key", "chunk", "piece")
        new = confirmed(met.mapInArrow(near_outer, "a long, b long"))
        if new.limit(1).count():
            labels = components(links.unionByName(new))
    of = nodes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return docs.select("id", "digest").join(of, "digest", "left").select(F.col("id").alias(id), "component_id")


def near_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df of which no other of their component has a smaller id; rows with a null id stay.

    Rows that share the id that stays are one document: of those one stays, that with the smallest
    hash of the text.
    """
    return firsts(df, simhash_components(df, id, text, **options), id, text)


def firsts(df: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What near_dedup keeps, for the components found (id, component_id)."""
    k, n, row = free(df, "id", "n", "row")
    stays = found.filter(F.col(id) == F.col("component_id")).groupBy(F.col(id).alias(k)).agg(F.count(F.lit(1)).alias(n))
    kept = df.join(stays, F.col(f"`{id}`") == F.col(k))
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = F.struct(*names)
    first = kept.filter(F.col(n) > 1).groupBy(k).agg(F.min_by(whole, F.struct(F.xxhash64(F.col(f"`{text}`")), F.to_json(whole))).alias(row)).select(f"{row}.*")
    return kept.filter(F.col(n) == 1).select(*names).unionAll(first).unionAll(df.filter(F.col(f"`{id}`").isNull()))
