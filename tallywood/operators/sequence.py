"""Operators on ordered rows: histories, islands, intervals, first rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def with_previous(captures: DataFrame, of: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Captures with the transition from the one before of the same key.

    captures: result, metric and bound. moved is the transition of the result; worth_a_look holds if the
    earlier metric isn't 0 and the change is over a quarter of it (of 1 at least); bound_shrunk if the
    new bound is shorter than six tenths of the old one.
    """
    w = Window.partitionBy(*of).orderBy(*order)
    rows = captures.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("result", "metric", "bound")} | {"nth": F.row_number().over(w)})
    delta = F.col("metric") - F.col("prev_metric")
    moved = F.when(F.col("nth") == 1, "nothing to compare").when(F.col("prev_result").eqNullSafe(F.col("result")), "same").when(F.col("result").eqNullSafe(F.lit("pass")), "improved").otherwise("REGRESSION")
    big = (F.col("prev_metric") != 0) & (F.abs(delta) / F.greatest(F.abs(F.col("prev_metric")), F.lit(1)) > 0.25)
    return rows.withColumns(
        {
            "moved": moved,
            "delta": F.round(delta, 4),
            "percent": F.round(F.try_divide(100 * delta, "prev_metric"), 2),
            "worth_a_look": F.coalesce(big, F.lit(False)),
            "bound_shrunk": F.coalesce(F.length("bound") < 0.6 * F.length("prev_bound"), F.lit(False)),
        }
    )


def latest(captures: DataFrame, of: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last capture of each key, combined before the shuffle."""
    return captures.groupBy(*of).agg(F.max(F.struct(*order, *values)).alias("m"), F.count(F.lit(1)).alias("n")).select(*of, *[F.col(f"m.{v}").alias(v) for v in values], "n")


def islands(df: DataFrame, of: Sequence[str], order: Sequence[str], apart: Column) -> DataFrame:
    """df with island, numbered from 1: a new one begins where apart holds for a row and the row before.

    apart may use the columns of order with the prefix ``prev_``.
    """
    w = Window.partitionBy(*of).orderBy(*order)
    rows = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in order})
    return rows.withColumn("island", 1 + F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(*[f"prev_{c}" for c in order])


def merged(spans: DataFrame, of: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Overlapping or touching spans of a key merged: (of, lo, hi, spans)."""
    w = Window.partitionBy(*of).orderBy(lo, hi)
    rows = spans.withColumn("__reach", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__n", F.sum(F.when(F.col(lo) <= F.col("__reach") + 1, 0).otherwise(1)).over(w))
    return rows.groupBy(*of, "__n").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("spans")).drop("__n")


def valid_from(versions: DataFrame, of: Sequence[str], at: str, tie: str) -> DataFrame:
    """versions with since and until: each holds from its time until the next one's."""
    w = Window.partitionBy(*of).orderBy(at, tie)
    return versions.withColumns({"since": F.col(at), "until": F.lead(at).over(w)})


def as_of(probes: DataFrame, versions: DataFrame, of: Sequence[str], at: str, version: str) -> DataFrame:
    """probes with the newest version of the same key at or before each: one sort of both kinds together.

    versions: of, at, version. A running last value over the union needs no join on a range, and rows
    of a key are sorted once.
    """
    both = probes.withColumns({"__v": F.lit(None).cast(versions.schema[version].dataType), "__p": F.lit(1)}).unionByName(versions.select(*of, at, F.col(version).alias("__v"), F.lit(0).alias("__p")), allowMissingColumns=True)
    w = Window.partitionBy(*of).orderBy(at, "__p", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(version, F.last("__v", ignorenulls=True).over(w)).filter("__p = 1").drop("__v", "__p")


def swept(marks: DataFrame, places: DataFrame, sums: Sequence[str], last: Sequence[str] = (), block: int = 1024, path: str | Sequence[str] = "path") -> DataFrame:
    """The distinct places (path, at) with the sums of the columns sums of all marks (path, at, …) of the path (a column or several) before at, and the
    values of the columns last of the nearest such mark (the one with the greatest at; ties: the greatest values).

    Places and marks are sorted together within blocks of block lines, and a block gets the totals of those before it. A
    path with a third of all rows is many blocks, and a window holds the places of one, however many rows ask for them.
    """
    path = [path] if isinstance(path, str) else list(path)
    held = F.struct(F.col("at").alias("__at"), *last)
    of = F.floor(F.col("at") / block).alias("__b")
    m = marks.select(*path, "at", of, *sums, held.alias("__last"), F.lit(True).alias("__mark"))
    p = places.select(*path, "at", of, F.lit(False).alias("__mark")).distinct()
    w = Window.partitionBy(*path, "__b").orderBy("at", "__mark", "__last").rowsBetween(Window.unboundedPreceding, -1)  # a mark at the place itself comes after it
    both = p.unionByName(m, allowMissingColumns=True)
    within = both.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums} | {"__near": F.last("__last", ignorenulls=True).over(w)}).filter("NOT __mark")
    totals = both.groupBy(*path, "__b").agg(*[F.sum(c).alias(c) for c in sums], F.max("__last").alias("__last"))
    b = Window.partitionBy(*path).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    before = totals.select(*path, "__b", *[F.coalesce(F.sum(c).over(b), F.lit(0)).alias(f"__of_{c}") for c in sums], F.max("__last").over(b).alias("__far"))
    near = F.coalesce("__near", "__far")
    return within.join(before, [*path, "__b"]).select(*path, "at", *[(F.col(f"__in_{c}") + F.col(f"__of_{c}")).alias(c) for c in sums], *[near[c].alias(c) for c in last])


def carried(pointers: DataFrame, hunks: DataFrame, path: str = "path") -> DataFrame:
    """pointers (path, id, lo, hi) carried across hunks (path, old_start, old_len, new_len): new_lo, new_hi.

    A pointer moves by the lines that hunks wholly above it add or take away; one that a hunk touches can't be carried and gets
    nulls. A hunk touches it where more hunks have begun at hi or above than have ended above lo. Both are sums of a sweep.
    """
    one = F.lit(1).cast("long")
    end = F.col("old_start") + F.greatest(F.col("old_len"), F.lit(1)) - 1
    above = hunks.select(path, end.cast("long").alias("at"), (F.col("new_len") - F.col("old_len")).cast("long").alias("shift"), one.alias("ended"))
    begun = hunks.select(path, F.col("old_start").cast("long").alias("at"), one.alias("begun"))
    p = pointers.select(path, "id", "lo", "hi")
    high = swept(begun, p.select(path, (F.col("hi") + 1).cast("long").alias("at")), ["begun"], path=path).select(path, (F.col("at") - 1).alias("hi"), "begun")
    low = swept(above, p.select(path, F.col("lo").cast("long").alias("at")), ["shift", "ended"], path=path).withColumnRenamed("at", "lo")
    both = p.join(low, [path, "lo"]).join(high, [path, "hi"])
    cut = F.col("begun") > F.col("ended")
    moved = lambda c: F.when(~cut, F.col(c) + F.col("shift")).cast("long")
    return both.select(path, "id", "lo", "hi", moved("lo").alias("new_lo"), moved("hi").alias("new_hi"), cut.alias("changed"))


def stale(regions: DataFrame, hunks: DataFrame, bucket: int = 64, path: str = "path") -> DataFrame:
    """(path, id, hits): regions (path, id, lo, hi) that hunks (path, start, len) overlap.

    Both sides go to the buckets of lines they touch, so the join has an equi-key besides the path, and
    a pair counts in the bucket where the later of the two begins.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    r = regions.withColumn("__b", F.explode(F.sequence(b("lo"), b("hi"))))
    h = hunks.select(path, "start", (F.col("start") + F.greatest(F.col("len"), F.lit(1)) - 1).alias("end")).withColumn("__b", F.explode(F.sequence(b("start"), b("end"))))
    met = r.join(h, [path, "__b"]).filter((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")) & (F.floor(F.greatest("start", "lo") / bucket) == F.col("__b")))
    return met.groupBy(path, "id").agg(F.count(F.lit(1)).alias("hits"))


def innermost(spans: DataFrame, points: DataFrame, path: str = "path", block: int = 1024) -> DataFrame:
    """points (path, at, …) with id, lo and hi of the smallest span (path, id, lo, hi) that holds at, null where none does.

    Spans of a path nest or lie apart; of equal ones that with the greatest id is the innermost. What a stack would hold is told
    by sums: the spans open at a place are those begun by then less those ended before, and a span's level is the number open where it
    begins, itself included and the inner ones that begin there left out. The innermost span at a place is the last one begun of the level that
    is open there. So two sweeps find it, one for the starts of spans and the points together, and no span meets the points that it holds.
    """
    from .graph import cut

    one = F.lit(1).cast("long")
    # each sweep asks for its rows twice, so they are made once
    of, points = cut(spans.select(path, "id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))), cut(points)
    change = of.select(path, (F.col("lo") - 1).alias("at"), one.alias("open")).unionAll(of.select(path, "hi", -one))
    places = points.select(path, F.col("at").cast("long").alias("at")).unionAll(of.select(path, "lo"))
    depth = cut(swept(change, places, ["open"], block=block, path=path))
    # spans that begin at one line: the outer ones first
    here = Window.partitionBy(path, "lo")
    same, n = F.row_number().over(here.orderBy(F.desc("hi"), "id")), F.count(F.lit(1)).over(here)
    level = of.withColumns({"same": same, "n": n}).join(depth.withColumnRenamed("at", "lo"), [path, "lo"]).withColumn("level", F.col("open") - F.col("n") + F.col("same"))
    marks = cut(level.select(path, "level", F.col("lo").alias("at"), F.struct("id", "lo", "hi").alias("span")))
    asked = depth.filter("open > 0").select(path, F.col("open").alias("level"), (F.col("at") + 1).alias("at"))
    last = swept(marks, asked, [], ["span"], block=block, path=[path, "level"]).select(path, (F.col("at") - 1).alias("at"), "span")
    return points.join(last, [path, "at"], "left").select(*points.columns, "span.id", "span.lo", "span.hi")


def smallest(df: DataFrame, of: Sequence[str], value: str, k: int) -> DataFrame:
    """(of, first, n): the k smallest values of each key in order, and how many there are.

    Taken and counted within salted groups first, so that a hot key's rows never meet in one task and df is read once.
    """
    salted = df.select(*of, value).withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    w = Window.partitionBy(*of, "__salt").orderBy(value)
    every = F.count(F.lit(1)).over(Window.partitionBy(*of, "__salt"))
    few = salted.withColumns({"__r": F.row_number().over(w), "__n": every}).filter((F.col("__r") <= k) | (F.col("__r") == 1))
    return few.groupBy(*of).agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("__r") <= k, F.col(value)))), 1, k).alias("first"), F.sum(F.when(F.col("__r") == 1, F.col("__n"))).alias("n"))
