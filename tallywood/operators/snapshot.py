"""Comparing two snapshots, and what one side has without the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame, key: str, attributes: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, the attributes before and after, change) of every key in either snapshot.

    change is ``added``, ``removed``, the name given for the first attribute that differs, or ``same``.
    attributes: (column, name of its change), in order of precedence. Nulls equal each other.
    """
    a = before.select(F.col(key).alias("__a"), *[F.col(c).alias(f"{c}_before") for c, _ in attributes])
    b = after.select(F.col(key).alias("__b"), *[F.col(c).alias(f"{c}_after") for c, _ in attributes])
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
    for c, name in attributes:
        change = change.when(~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")), name)
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    return both.select(F.coalesce("__a", "__b").alias(key), *[F.col(f"{c}_{s}") for c, _ in attributes for s in ("before", "after")], change.otherwise("same").alias("change"))


def listed(derived: DataFrame, authored: DataFrame, key: str, faces: Sequence[str]) -> DataFrame:
    """Derived entries joined to authored ones: the authored face wins, entries of one side only stay.

    rank gives the order of faces; a face that isn't among them, or none, comes last.
    """
    d = derived.select(F.col(key).alias("__d"), F.col("face").alias("__face"))
    a = authored.select(F.col(key).alias("__a"), F.col("face").alias("__own"), "grade")
    face = F.coalesce("__own", "__face")
    rank = F.lit(len(faces))
    for k, f in reversed(list(enumerate(faces))):
        rank = F.when(face == f, k).otherwise(rank)
    origin = F.when(F.col("__a").isNull(), "derived").when(F.col("__d").isNull(), "authored").otherwise("both")
    return d.join(a, F.col("__d") == F.col("__a"), "full").select(F.coalesce("__d", "__a").alias(key), face.alias("face"), "grade", origin.alias("origin"), rank.cast("int").alias("rank"))


def unmapped(derived: DataFrame, authored: DataFrame, key: str) -> DataFrame:
    return derived.join(authored, key, "left_anti")


def one_sided(declared: DataFrame, read: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys that only one of two key sets has, with the side that lacks them."""
    d = declared.select(*keys).distinct().withColumn("__d", F.lit(True))
    r = read.select(*keys).distinct().withColumn("__r", F.lit(True))
    return d.join(r, list(keys), "full").filter("__d IS NULL OR __r IS NULL").select(*keys, F.when(F.col("__r").isNull(), "not read").otherwise("not declared").alias("gap"))


def best(candidates: DataFrame, of: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """For each group of the columns of, the values of the row that comes first in order.

    A struct minimum, so rows are combined before they are shuffled and no group is sorted.
    """
    picked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(v) for v in values])
    return candidates.groupBy(*of).agg(F.min(picked).alias("__m")).select(*of, *[F.col(f"__m.{v}").alias(v) for v in values])
