"""Pointers to lines carried from one state of a file to another: by its hunks, through a proof, or by an unchanged line.

Hunks (path, old_start, old_len, new_start, new_len) of a path don't overlap; one of old length 0 stands after its old_start. A
pointer is (path, id, lo, hi). Where a pointer ends up is a sum over the hunks before it, so hunks and pointers are swept together: prefix
sums over both, sorted by line within blocks of a path's lines, and over the blocks' totals (sequence.swept). No pair of a
hunk and a pointer is made, and a path with a third of all rows is many blocks.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import swept

HUNK = "old_start int, old_len int, new_start int, new_len int"


def hunks(files: DataFrame) -> DataFrame:
    """(path, old_start, old_len, new_start, new_len) of files (path, old, new): the changed blocks, without lines around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, old, new in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                before, after = (old or "").split("\n"), (new or "").split("\n")
                for tag, i, j, k, m in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
                    if tag != "equal":
                        rows.append((path, i + (j > i), j - i, k + (m > k), m - k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int32()] * 4), strict=True)], names=["path", "old_start", "old_len", "new_start", "new_len"])

    return files.select("path", "old", "new").mapInArrow(run, f"path string, {HUNK}")


def _ends(hunks: DataFrame) -> DataFrame:
    """hunks with end, the last old line that is theirs or before them."""
    return hunks.withColumn("end", F.when(F.col("old_len") == 0, F.col("old_start")).otherwise(F.col("old_start") + F.col("old_len") - 1))


def _at(rows: DataFrame, column: str, marks: DataFrame, sums: list[str], last: list[str] = [], plus: int = 0) -> DataFrame:  # noqa: B006  never changed
    """(path, column, sums, last) of a sweep at the places column + plus of rows."""
    place = rows.select("path", (F.col(column) + plus).cast("long").alias("at"))
    return swept(marks, place, sums, last).withColumn(column, F.col("at") - plus).drop("at")


def carried(pointers: DataFrame, hunks: DataFrame) -> DataFrame:
    """pointers with now_lo and now_hi, both null where a hunk falls inside.

    Lines move by what hunks that end before them add or take away. A hunk is inside if it has ended at lo or later and begun
    at hi or earlier, an insertion before hi; that is so where more hunks have begun than ended.
    """
    h, one = _ends(hunks), F.lit(1).cast("long")
    ended = h.select("path", F.col("end").cast("long").alias("at"), (F.col("new_len") - F.col("old_len")).cast("long").alias("shift"), one.alias("ended"))
    # begun at hi or earlier is before hi + 1; an insertion counts from the line after it
    begun = h.select("path", (F.col("old_start") + F.when(F.col("old_len") == 0, 1).otherwise(0)).cast("long").alias("at"), one.alias("begun"))
    both = pointers.join(_at(pointers, "lo", ended, ["shift", "ended"]), ["path", "lo"]).join(_at(pointers, "hi", begun, ["begun"], plus=1), ["path", "hi"])
    free = F.col("begun") == F.col("ended")
    moved = lambda c: F.when(free, F.col(c) + F.col("shift")).cast("long")
    return both.select(*pointers.columns, moved("lo").alias("now_lo"), moved("hi").alias("now_hi"))


def translated(pointers: DataFrame, hunks: DataFrame) -> DataFrame:
    """pointers with now_lo and now_hi, widened where an end falls into a hunk: to the whole of its newer side, or to the lines
    either side of it where it has none."""
    h = _ends(hunks)
    marks = h.select("path", F.col("end").cast("long").alias("at"), (F.col("new_len") - F.col("old_len")).cast("long").alias("shift"))
    begun = h.filter("old_len > 0").select("path", F.col("old_start").cast("long").alias("at"), "end", "new_start", "new_len")
    # both ends of all pointers are places of one sweep
    ends = pointers.select("path", F.explode(F.array("lo", "hi")).alias("x"))
    inside = _at(ends, "x", begun, [], ["end", "new_start", "new_len"], plus=1)
    found = _at(ends, "x", marks, ["shift"]).join(inside, ["path", "x"])

    def place(last: bool):
        edge = F.col("new_start") + F.col("new_len") - 1 if last else F.col("new_start")
        edge = F.when(F.col("new_len") > 0, edge).otherwise(F.greatest(F.lit(1), F.col("new_start") + (1 if last else 0)))
        return F.when(F.col("x") <= F.col("end"), edge).otherwise(F.col("x") + F.col("shift")).cast("long")

    side = lambda c, last: found.select("path", F.col("x").alias(c), place(last).alias(f"now_{c}"))
    both = pointers.join(side("lo", False), ["path", "lo"]).join(side("hi", True), ["path", "hi"])
    return both.select(*pointers.columns, "now_lo", F.greatest("now_lo", "now_hi").alias("now_hi"))


def rewritten(pointers: DataFrame, hunks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, id, found): for one-line pointers inside a hunk, the line of its newer side that alone has the pointer's old text.

    old, new: (path, line, said). Texts without two word characters in a row name nothing.
    """
    h = _ends(hunks).filter("old_len > 0")
    begun = h.select("path", F.col("old_start").cast("long").alias("at"), F.col("old_start").alias("hunk"), "end")
    lone = pointers.filter("lo = hi")
    inside = lone.join(_at(lone, "lo", begun, [], ["hunk", "end"], plus=1), ["path", "lo"]).filter(F.col("lo") <= F.col("end"))
    asked = inside.join(old.select("path", F.col("line").alias("lo"), "said"), ["path", "lo"]).filter(F.col("said").rlike(r"\w\w")).select("path", "id", "hunk", "said")
    sides = h.filter("new_len > 0").select("path", F.col("new_start").cast("long").alias("at"), F.col("old_start").alias("hunk"), (F.col("new_start") + F.col("new_len") - 1).alias("end"))
    lines = new.join(_at(new, "line", sides, [], ["hunk", "end"], plus=1), ["path", "line"]).filter(F.col("line") <= F.col("end"))
    alone = lines.groupBy("path", "hunk", "said").agg(F.count(F.lit(1)).alias("times"), F.min("line").alias("found")).filter("times = 1")
    return asked.join(alone, ["path", "hunk", "said"]).select("path", "id", F.col("found").cast("long").alias("found"))


def reaimed(pointers: DataFrame, hunks: DataFrame, old: DataFrame, new: DataFrame, between: DataFrame | None = None, after: DataFrame | None = None, proofs: DataFrame | Column | None = None) -> DataFrame:
    """pointers with state, now_lo and now_hi.

    kept: they stand as they are. moved: no hunk is inside; carried. proved: a hunk is inside, but between holds the hunks up to
    a proof and after those since, the pointer is among proofs ((path, id), or a condition on its columns), and the lines that the proof saw are
    carried on. found: one line was rewritten around, and stands unchanged in the change once. by hand: one line that isn't found again; now is null.
    declined: a hunk is inside a range; now is the best reading (translated) and nothing is moved. The file's first line stays what it is.

    Pointers to the same lines go the same way, so the sweeps see each (path, lo, hi) once and without ids, and those that only
    places with a hunk inside need see only these; pointers then ask for their place in one join.
    """
    from .graph import cut

    spot, c, columns = ["path", "lo", "hi"], F.col, pointers.columns
    pointers = cut(pointers)
    direct = cut(carried(pointers.select(*spot).distinct(), hunks))
    stuck = direct.filter("now_lo IS NULL").select(*spot)
    best = translated(stuck, hunks).select(*spot, c("now_lo").alias("best_lo"), c("now_hi").alias("best_hi"))
    out = direct.join(best, spot, "left")
    names = ["proof_lo", "proof_hi"]
    if between is not None and after is not None:
        seen = cut(translated(stuck, between).select("path", c("lo").alias("__lo"), c("hi").alias("__hi"), c("now_lo").alias("lo"), c("now_hi").alias("hi")))
        then = carried(seen, after)
        out = out.join(then.select("path", c("__lo").alias("lo"), c("__hi").alias("hi"), c("now_lo").alias(names[0]), c("now_hi").alias(names[1])), spot, "left")
    else:
        out = out.withColumns({n: F.lit(None).cast("long") for n in names})
    found = rewritten(stuck.withColumn("id", c("lo")), hunks, old, new).select("path", c("id").alias("lo"), c("id").alias("hi"), "found")
    out = out.join(found, spot, "left")
    if isinstance(proofs, DataFrame):
        pointers, proved = pointers.join(proofs.select("path", "id").distinct().withColumn("__proved", F.lit(True)), ["path", "id"], "left"), F.coalesce("__proved", F.lit(False))
    else:
        proved = F.lit(True) if proofs is None else F.coalesce(proofs, F.lit(False))
    out = pointers.withColumn("__proved", proved).join(out, spot)
    lone = (c("lo") == c("hi")) & (c("lo") > 1)
    shown = c("__proved") & c("proof_lo").isNotNull()
    state = (
        F.when(c("now_lo").isNotNull(), F.when((c("now_lo") == c("lo")) & (c("now_hi") == c("hi")), "kept").otherwise("moved"))
        .when(lone, F.when(c("found").isNotNull(), "found").otherwise("by hand")).when(shown, "proved").otherwise("declined")
    )
    place = lambda now, proof, best: F.coalesce(c(now), F.when(lone, c("found")).otherwise(F.coalesce(F.when(shown, c(proof)), c(best))))
    return out.select(*columns, state.alias("state"), place("now_lo", "proof_lo", "best_lo").alias("now_lo"), place("now_hi", "proof_hi", "best_hi").alias("now_hi"))
