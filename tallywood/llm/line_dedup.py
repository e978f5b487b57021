"""Line dedup by winnowing over line hashes (operator 2), with DataFrame functions only.

Order: documents by doc_id, then by the hash of the text; lines by position. Lines are the parts
between newlines; they are compared, by MD5, without white space at either end. Lines without a word don't
count: they break no run and are never deleted.

A run of lines goes if it has min_words words or more and the same lines stand, one after the other,
at an earlier place.

1. Winnow. From every line a window reaches forward over as few lines as hold min_words words, and
   another one backward. The first smallest line hash of a window is its fingerprint. Equal windows choose
   the same fingerprint, so a run of min_words words always shares one with its earlier place.
2. Join positions. Each position of a fingerprint meets the earliest position of the same fingerprint; those
   that stand at one position only are dropped before any neighbour is looked at.
3. Extend both ways. A position carries its neighbours, on either side as few lines as hold min_words words
   and so all that its windows reach. A match grows backward and forward while the neighbours are
   equal; if it holds min_words words it is a run with an earlier place.
4. Where a match ends before the neighbours do, another position may match further. Those windows of the later
   position that lie outside the match are looked up among the earliest places of equal windows, by 128 bits
   of their line hashes. Windows that equal one of the earliest position lie inside the match, so
   nothing is missed, and no two positions are compared but with the earliest: the work stays linear
   however many places share a line.
5. Delete the lines of the runs found.

A fingerprint that a third of all places share is no group of one task: both sides of each join are plain tables
by then, which adaptive execution splits, or the side of earliest places is broadcast, below a quarter of SMALL_ROWS rows (with neighbours: that number by twice min_words).

Defined results: a null text stays null; an empty one stays empty; a text that loses all its lines
becomes empty; rows with equal doc_id and text are one document and treated alike; a null doc_id
comes before all others. Every line of a text counts, however long the text is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, free, let, small, staged, without

#: Words are runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"


def _reach(words: Column, min_words: int) -> Column:
    """How many of the first lines hold min_words words; 0 if all of them don't."""
    done = F.aggregate(
        words,
        F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("w")),
        lambda acc, w: F.when(acc["w"] >= min_words, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["w"] + w).alias("w"))),
    )
    return let(done, lambda x: F.when(x["w"] >= min_words, x["n"]).otherwise(0))


def _windows(hashes: Column, words: Column, min_words: int) -> Column:
    """Every window of a run of lines: its first line, its last line, and where its fingerprint stands, from 1."""
    n = F.size(hashes)

    def window(start: Column, size: Column) -> Column:
        return let(
            F.slice(hashes, start, size),
            lambda part: F.struct(
                start.alias("first"), (start + size - 1).alias("last"), (start + F.array_position(part, F.array_min(part)) - 1).cast("int").alias("print")
            ),
        )

    def forward(i: Column) -> Column:
        return let(_reach(F.slice(words, i, F.lit(min_words)), min_words), lambda k: F.when(k > 0, window(i, k)))

    def backward(i: Column) -> Column:
        first = F.greatest(i - min_words + 1, F.lit(1))
        return let(_reach(F.reverse(F.slice(words, first, i - first + 1)), min_words), lambda k: F.when(k > 0, window(i - k + 1, k)))

    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.concat(F.transform(places, forward), F.transform(places, backward)), lambda w: w.isNotNull())


def _position(hashes: Column, words: Column, at: Column, j: Column, min_words: int) -> Column:
    """Position j with its neighbours: hashes, words and line numbers of all, and how many stand before j."""
    start = F.greatest(j - min_words, F.lit(1))
    before, after = F.reverse(F.slice(words, start, j - start)), F.slice(words, j + 1, F.lit(min_words))

    def whole(part: Column) -> Column:
        return let(_reach(part, min_words), lambda k: F.when(k > 0, k).otherwise(F.size(part)))

    return let(
        F.struct(whole(before).alias("a"), whole(after).alias("b")),
        lambda x: F.struct(
            F.element_at(hashes, j).alias("fingerprint"),
            j.alias("position"),
            x["a"].alias("before"),
            F.slice(hashes, j - x["a"], x["a"] + x["b"] + 1).alias("h"),
            F.slice(words, j - x["a"], x["a"] + x["b"] + 1).alias("w"),
            F.slice(at, j - x["a"], x["a"] + x["b"] + 1).alias("i"),
        ),
    )


def _equal(most: Column, pair: Callable[[Column], Column]) -> Column:
    """For how many of 1, 2, ... most pair holds, one after the other."""
    flags = F.transform(F.sequence(F.lit(1), most), pair)
    return F.when(most > 0, let(F.array_position(flags, F.lit(False)), lambda p: F.when(p > 0, p - 1).otherwise(most))).otherwise(0).cast("int")


def repeated_lines(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(doc, text_hash, gone): the positions, from 0, of the lines to delete, for each document with any."""
    docs = df.select(F.col(f"`{id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    # [\s] of Java's trim patterns differs between releases; the class is spelled out
    seen = F.transform("lines", lambda x, i: F.struct(F.size(F.regexp_extract_all(x, F.lit(f"({WORD})"))).alias("w"), i.alias("i"), F.unhex(F.md5(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))).alias("h")))
    sketch = docs.select("doc", "text_hash", F.filter(seen, lambda x: x["w"] > 0).alias("seen"))
    sketch = sketch.filter(F.size("seen") > 0).select("doc", "text_hash", F.col("seen.h").alias("hashes"), F.col("seen.w").alias("words"), F.col("seen.i").alias("at"))
    sketch = staged(sketch, "line_hashes")

    hashes, words = F.col("hashes"), F.col("words")
    chosen = F.array_distinct(F.transform(_windows(hashes, words, min_words), lambda w: w["print"]))
    positions = sketch.select("doc", "text_hash", F.explode(F.transform(chosen, lambda j: _position(hashes, words, F.col("at"), j, min_words))).alias("p"))
    positions = staged(positions.select(F.struct("doc", "text_hash", "p.position").alias("place"), "p.fingerprint", "p.before", "p.h", "p.w", "p.i"), "positions")

    shared = positions.groupBy("fingerprint").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    shared = staged(shared.filter(~F.col("first").eqNullSafe(F.col("last"))).select("fingerprint", "first"), "shared")
    meeting = staged(positions.join(small(shared, SMALL_ROWS // 4), "fingerprint"), "meeting")
    ahead = meeting.filter(F.col("place").eqNullSafe(F.col("first"))).groupBy("fingerprint").agg(F.first(F.struct(F.col("before").alias("qb"), F.col("h").alias("q"))).alias("x"))
    ahead = staged(ahead.select("fingerprint", "x.*"), "ahead")
    b, n, qb, qn = F.col("before"), F.size("h"), F.col("qb"), F.size("q")
    matches = staged(
        meeting.filter(F.col("place") > F.col("first"))
        .join(small(ahead, SMALL_ROWS // (2 * min_words)), "fingerprint")
        .select(
            "place", "before", "h", "w", "i",
            _equal(F.least(b, qb), lambda k: F.element_at("h", b + 1 - k) == F.element_at("q", qb + 1 - k)).alias("back"),
            _equal(F.least(n - b, qn - qb) - 1, lambda k: F.element_at("h", b + 1 + k) == F.element_at("q", qb + 1 + k)).alias("forth"),
        ),
        "matches",
    )
    start, length = b + 1 - F.col("back"), F.col("back") + F.col("forth") + 1
    held = F.aggregate(F.slice("w", start, length), F.lit(0).cast("long"), lambda s, w: s + w)
    runs = matches.filter(held >= min_words).select("place", F.slice("i", start, length).alias("cover"))

    outside = F.filter(
        _windows(F.col("h"), F.col("w"), min_words),
        lambda w: (w["print"] == b + 1) & ((w["first"] < start) | (w["last"] > b + 1 + F.col("forth"))),
    )
    rest = matches.filter((F.col("back") < b) | (F.col("forth") < n - b - 1)).select("place", "h", "i", F.explode(F.array_distinct(outside)).alias("o"))
    span = F.col("o.first"), F.col("o.last") - F.col("o.first") + 1
    rest = rest.select("place", F.slice("h", *span).alias("h"), F.slice("i", *span).alias("cover"))
    rest = staged(rest.select("place", F.xxhash64("h").alias("x"), F.xxhash64(F.lit(1), "h").alias("y"), "cover"), "rest")
    again = rest.groupBy("x", "y").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    again = staged(again.filter(~F.col("first").eqNullSafe(F.col("last"))).select("x", "y", "first"), "again")
    runs = runs.unionAll(rest.join(small(again, SMALL_ROWS // 4), ["x", "y"]).filter(F.col("place") > F.col("first")).select("place", "cover"))
    lines = runs.select("place.doc", "place.text_hash", F.explode("cover").alias("line"))
    return lines.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("gone"))


def line_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """df with the column text less its repeated runs, and the columns n_lines and n_deleted.

    Columns of df called n_lines or n_deleted are replaced.
    """
    base = without(df, ["n_lines", "n_deleted"])
    gone = repeated_lines(df, id, text, min_words)
    mine = F.col(f"`{id}`")
    h, d, k, g = free(base, "hash", "doc", "key", "gone")
    keyed = base.withColumn(h, F.xxhash64(F.col(f"`{text}`")))
    gone = gone.select(F.col("doc").alias(d), F.col("text_hash").alias(k), F.col("gone").alias(g))
    joined = keyed.join(gone, mine.eqNullSafe(F.col(d)) & (F.col(h) == F.col(k)), "left")
    left = let(
        F.split(F.col(f"`{text}`"), "\n"),
        lambda lines: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g)), lambda i: F.get(lines, i))),
    )
    new = F.when(F.col(g).isNull(), F.col(f"`{text}`")).otherwise(left)
    return joined.select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in base.columns],
        F.coalesce(F.size(F.split(F.col(f"`{text}`"), "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_deleted"),
    )
