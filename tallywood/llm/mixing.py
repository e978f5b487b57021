r"""Mixing sources to target weights (operator 13): weighted fair queueing over shuffled documents.

The documents of a source stand in a queue in a shuffled order, as often as they may be repeated: all first copies,
then all second ones. A copy's virtual finish time is the number of its source's words up to its end, divided by the
source's weight. All copies are sorted by finish time over all sources, and the mix ends where the budget does. Sources
that run out leave their part to the others, so each one's words come near a target that is filled like water: by
weight, but not above the words that the source has in all its copies.

Queues and the mix are running sums over all rows in order (common.running): a range shuffle of narrow rows, sums
within each part, and one offset for each part. No window holds a source, so a source may have any share of the rows.
Only a few numbers a round reach the driver. Whole documents are taken, so a source may miss its target by about
its longest document.

Defined results: a null or empty text has size 0 and is taken 0 times its size; a null source is one more source, after
all others; rows that share doc_id, source and size are interchangeable, and each may be taken; a null doc_id is shuffled
as an empty one; an empty table gives an empty one; columns besides doc_id, source and text aren't read, whatever their names.
The order is fixed by seed, doc_id and size: another run gives the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, small, staged


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level(sources: DataFrame, budget: Fraction, most: int) -> tuple[float, float]:
    """(rest, weight): open sources get rest * own weight / weight; a source is full if that is above most times its size.

    sources: source_size and weight, a staged table. Each round is one aggregate of it to one row. The level only
    rises, so the full sources are those below it, and rounds end when their number stays.
    """
    cap = F.col("source_size") * most
    rest, weight, closed = budget, sources.agg(F.sum("weight")).first()[0] or 0.0, 0
    while weight:
        full = cap < F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))
        n, held, left = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == closed:
            break
        rest, weight, closed = budget - (held or 0), left or 0.0, n
    return float(rest), float(weight)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> tuple[DataFrame, Fraction]:
    """(source, source_size, nth, weight, before, target) and the whole budget, from (source, size).

    Sources stand by code point, null last, and take the weights in turn; before: the words of the sources before it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    placed = running(each, ["last", "source"], {"one": "nth", "source_size": "upto"})
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    ranked = staged(placed.select("source", "source_size", "nth", turn.alias("weight"), (F.col("upto") - F.col("source_size")).alias("before")), "sources")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rest, weight = level(ranked, budget, most)
    cap = (F.col("source_size") * most).cast("double")
    by_weight = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
    return ranked.withColumn("target", F.when(F.lit(weight == 0), cap).otherwise(F.least(cap, by_weight))), budget


def queued(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 13) -> DataFrame:
    """All copies of all documents in the mix's order: row, doc_id, source, size, source_size, target, copy (from 0), finish, upto, taken.

    upto: the words of the mix up to the copy's end; taken: whether they are within the budget; row: one number for each row of docs.
    """
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id())
    narrow = staged(narrow, "sizes")
    sources, budget = targets(narrow, weights, share, most)
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    lined = running(narrow.withColumns({"last": F.col("source").isNull(), "shuffled": shuffled}), ["last", "source", "shuffled", "doc_id", "size", "row"], {"size": "upto"})
    known = lined.join(small(sources, 100_000).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    done = F.col("upto") - F.col("before") + F.col("copy") * F.col("source_size")
    timed = copies.select("row", "doc_id", "source", "size", "source_size", "target", "nth", "shuffled", "copy", (done / F.col("weight")).alias("finish"))
    return running(timed, ["finish", "nth", "copy", "shuffled", "doc_id", "size", "row"], {"size": "upto"}).withColumn("taken", F.col("upto") <= F.lit(int(budget))).drop("nth", "shuffled")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the copies within the budget, each with the place where its words end (upto)."""
    return queued(docs, **how).filter("taken").drop("taken")


def amounts(docs: DataFrame, **how) -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target (of its source), taken (words, repeats counted)."""
    each = queued(docs, **how).groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    return each.drop("row")
