r"""Phrase collocation mining (operator 12): weighted n-grams of distinct pieces, counted out of core in duckdb.

Texts are cut into pieces, and equal pieces of a language become one with a multiplicity, so copies are counted
without being read again. Then level by level, from single words to the longest phrases:

1. A task numbers the words of a few MB of pieces and adds up the multiplicities of equal n-grams in numpy.
   It looks only at n-grams whose two shorter parts may be frequent, by a bit map of hashes of the level
   before. The map has a bounded size (`MAP_BITS`); a full one lets more n-grams through but never loses one.
2. The partial counts are shuffled by hash of the phrase, and each task counts its bucket in a duckdb database of its own,
   with a memory limit beyond which it spills to the task's scratch folder. That folder holds nothing that another
   task reads, and it goes when the task ends; a lost executor's buckets are counted again from the shuffle.
3. Phrases that are too rare end there: none of a frequent phrase's parts is rarer than the phrase.

A phrase asks for the counts of its parts by lookup requests that are shuffled to the parts' counts (a join that adaptive
execution can split where a part is hot) and answers meet again at the phrase. Scores are exact decimals. The places
within a language come from one range sort of all phrases (common.running), so no task holds a language.

Defined results: a null or empty text has no pieces; a null lang is `und` and shares its counts with texts so labelled;
pieces of any length are taken whole; repeated rows count each time; ties of scores go to the higher count, then to the
phrase in byte order; an empty table gives an empty one; columns besides text and lang aren't read, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, sliced, small, staged

#: Bytes of pieces that a task numbers at a time, bytes that a bucket's database may hold in memory, and the largest bit map.
CHUNK_BYTES, BUCKET_MEMORY, MAP_BITS = 14 << 20, "300MB", 27
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pieces_of(langs: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, piece, m) of some rows, equal pieces of a language once."""
    texts = pc.ascii_lower(texts.fill_null(""))
    listed = pc.split_pattern_regex(texts, r"[.,;:!?\n-\r]")
    piece = pc.ascii_trim(pc.replace_substring_regex(listed.flatten(), r"[ \t]+", " "), " ")
    lang = langs.fill_null("und").take(pc.list_parent_indices(listed))
    some = pc.not_equal(piece, "")
    rows = pa.table({"lang": lang.cast(pa.string()), "piece": piece}).filter(some)
    found = rows.group_by(["lang", "piece"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"lang": found["lang"], "piece": found["piece"].cast(pa.string()), "m": found["count_all"].cast(pa.int64())})


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces, words joined by one blank, and how often each comes; A-Z in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, [1], CHUNK_BYTES):
                yield from _pieces_of(part.column(0), part.column(1)).to_batches(20_000)

    each = docs.select("lang", "text").mapInArrow(run, "lang string, piece string, m long")
    return each.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A) ^ b
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def _within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def grams(part: pa.Table, size: int, known: np.ndarray | None) -> pa.Table:
    """(lang, phrase, f) of the n-grams of size words in part (lang, piece, m): sums of m, equal n-grams once."""
    langs, listed = part["lang"].combine_chunks().dictionary_encode(), pc.split_pattern(part["piece"].combine_chunks(), " ")
    words = listed.values.dictionary_encode()
    w, offsets = words.indices.to_numpy(), listed.offsets.to_numpy()
    n = np.diff(offsets)
    end, lang = np.repeat(offsets[1:], n).astype(np.int64), np.repeat(langs.indices.to_numpy(), n)
    last = np.maximum(len(w) - size + 1, 0)
    h = _mixed(_hashes(langs.dictionary)[lang], _hashes(words.dictionary)[w])
    single, before = h, h
    for k in range(1, size):
        before = h
        h = _mixed(h[:-1], single[k:]) if len(h) else h
    whole = np.arange(last) + size <= end[:last]
    if size > 1 and known is not None and last:
        whole &= _within(known, before[:last])
        whole &= _within(known, _second(single, size)[:last])
    at = np.flatnonzero(whole)
    key, m = h[at], np.repeat(part["m"].to_numpy(), n)[at]
    order = np.argsort(key, kind="stable")
    key, at, m = key[order], at[order], m[order]
    differs = np.ones(len(at), bool)
    differs[1:] = key[1:] != key[:-1]
    for k in range(size):  # equal hashes of other words make a group of their own
        differs[1:] |= (w[at[1:] + k] != w[at[:-1] + k]) | (lang[at[1:]] != lang[at[:-1]])
    first = np.flatnonzero(differs)
    f = np.add.reduceat(m, first) if len(first) else m
    columns = [words.dictionary.take(pa.array(w[at[first] + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0]
    return pa.table({"lang": langs.dictionary.take(pa.array(lang[at[first]])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "f": pa.array(f, pa.int64())})


def _second(single: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size - 1 words after each place's first."""
    h = single[1:]
    for k in range(2, size):
        h = _mixed(h[:-1], single[k:])
    return h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def counted(parts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) with f >= least, summed from partial counts: each hash bucket in a duckdb database of its own."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory(prefix="phrases-") as scratch, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": os.path.join(scratch, "spill"), "preserve_insertion_order": False}) as con:
            con.execute("CREATE TABLE parts (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            for t in _chunks(b for group in ([first], batches) for b in group):
                con.register("more", t)
                con.execute("INSERT INTO parts SELECT lang, phrase, f FROM more")
                con.unregister("more")
            found = con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            for b in found.to_arrow_reader(50_000):
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2)], names=["lang", "phrase", "f"])

    return parts.repartition("lang", "phrase").mapInArrow(bucket, "lang string, phrase string, f long")


def bit_map(frequent: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of the n phrases of a level: 16 bits for each phrase or more, at most 2 ** MAP_BITS in all.

    Tasks give slices of 8 KB, which are ORed in tasks by slice; what the driver gets is the map, whatever n is.
    """
    bits = min(max(16, (16 * n).bit_length()), MAP_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            listed = pc.split_pattern(b.column(1), " ")
            w, langs = listed.values.dictionary_encode(), b.column(0).dictionary_encode()
            offsets = listed.offsets.to_numpy()[:-1]
            if not len(offsets):
                continue
            hw, at = _hashes(w.dictionary)[w.indices.to_numpy()], offsets
            h = _mixed(_hashes(langs.dictionary)[langs.indices.to_numpy()], hw[at])
            for k in range(1, int(listed.offsets[1].as_py() - listed.offsets[0].as_py())):
                h = _mixed(h, _mixed(_hashes(langs.dictionary)[langs.indices.to_numpy()], hw[at + k]))
            own[h & np.uint64((1 << bits) - 1)] = True
        yield from _slices({i: own[i << 16 : (i + 1) << 16] for i in range(1 << bits - 16)})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(bool)
                own[i] = own[i] | got if i in own else got
        yield from _slices(own)

    schema = "slice int, bits binary"
    rows = frequent.select("lang", "phrase").mapInArrow(places, schema).repartition("slice").mapInArrow(merged, schema).collect()
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in rows:
        out[r.slice << 13 : (r.slice + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out


def _slices(of: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    full = [(i, x) for i, x in of.items() if x.any()]
    for k in range(0, len(full), 64):
        part = full[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for _, x in part], pa.binary())], names=["slice", "bits"])


def frequent(of: DataFrame, longest: int = 5, least: int = 100) -> list[DataFrame]:
    """For 1 to longest words, the (lang, phrase, f) with f >= least over the staged pieces of; each table is staged."""
    spark, out, known = of.sparkSession, [], None
    for size in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(known) if known is not None else None

        def parts(batches: Iterator[pa.RecordBatch], size: int = size, shared=shared) -> Iterator[pa.RecordBatch]:
            bits = shared.value if shared is not None else None
            for t in _chunks(batches):
                yield from grams(t, size, bits).to_batches(50_000)

        level = staged(counted(of.mapInArrow(parts, "lang string, phrase string, f long"), least), f"phrases{size}")
        out.append(level)
        n = level.count()
        if not n or size == longest:
            break
        known = bit_map(level, n)
    return out


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) of longs, exact: products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    both = (wide(left) * wide(right)).cast("decimal(38,0)")
    return F.call_function("div", (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), both)


def cuts(phrases: DataFrame, parts: DataFrame, totals: DataFrame, longest: int = 5) -> DataFrame:
    """phrases (lang, phrase, a) with n and the counts l, r and score of the cut that scores least (ties: the first).

    Every cut sends two requests, which meet the parts' counts by the part's hash.
    """
    w = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.size(w) - 1))
    asked = phrases.select("lang", "phrase", "a", w.alias("w"), k.alias("k"))
    first, rest = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("part")), F.struct(F.lit(1).alias("side"), rest.alias("part"))))
    requests = asked.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    answers = requests.join(parts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    each = [F.max(F.when((F.col("k") == i) & (F.col("side") == s), F.col("f"))).alias(f"f{i}{s}") for i in range(1, longest) for s in (0, 1)]
    met = answers.groupBy("lang", "phrase", "a").agg(*each).join(small(totals, 100_000), "lang")
    scored = [F.when(F.col(f"f{i}0").isNotNull(), F.struct(score(F.col("a"), F.col("n"), F.col(f"f{i}0"), F.col(f"f{i}1")).alias("score"), F.lit(i).alias("k"), F.col(f"f{i}0").alias("l"), F.col(f"f{i}1").alias("r"))) for i in range(1, longest)]
    return met.withColumn("best", F.array_min(F.array_compact(F.array(*scored)))).select("lang", "phrase", "a", "n", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to longest words that come least times or more.

    A phrase goes if one a word longer holds it and has share percent or more of its count; longer ones have less than that
    one has. top: so many phrases of each language, by score, count and phrase; None is all.
    """
    of = staged(pieces(docs), "pieces")
    totals = staged(of.groupBy("lang").agg(F.sum(F.col("m") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).alias("n")), "totals")
    levels = frequent(of, longest, least)
    counts = levels[0]
    for x in levels[1:]:
        counts = counts.unionByName(x)
    found = counts.withColumn("words", F.size(F.split("phrase", " "))).filter("words > 1")
    w = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " ")))
    held = found.filter("words > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    own = found.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < share * F.col("f"))).select("lang", "phrase", F.col("f").alias("a"))
    scored = cuts(own, counts, totals, longest).withColumns({"by_score": -F.col("score"), "by_count": -F.col("a"), "one": F.lit(1).cast("long")})
    placed = running(scored, ["lang", "by_score", "by_count", "phrase"], {"one": "place"})
    before = small(staged(placed.groupBy("lang").agg((F.min("place") - 1).alias("before")), "first_places"), 100_000)
    out = placed.join(before, "lang").withColumn("rank", F.col("place") - F.col("before"))
    return (out if top is None else out.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
