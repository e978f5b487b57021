"""Ceilings that may only go down, and findings held against a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ceiling_number(text: Column) -> Column:
    """A ceiling as written; what isn't a whole number reads as 0."""
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(0).cast("long"))


def ratcheted(counts: DataFrame, ceilings: DataFrame, key: str, count: str = "n", ceiling: str = "ceiling") -> DataFrame:
    """Counts held against ceilings: verdict and the ceiling a ratchet would write.

    Above the ceiling is ``over`` and blocks the ratchet; below can tighten; a key without a ceiling
    fails on any count. Keys with a ceiling and no count have the count 0.
    """
    both = counts.select(key, F.col(count).alias("n")).join(ceilings.select(key, F.col(ceiling).alias("ceiling")), key, "full")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    verdict = F.when(F.col("ceiling").isNull(), F.when(n > 0, "no ceiling").otherwise("ok")).when(n > F.col("ceiling"), "over").when(n < F.col("ceiling"), "can tighten").otherwise("ok")
    return both.select(key, n.alias("n"), F.col("ceiling").cast("long").alias("ceiling"), verdict.alias("verdict"), F.least(F.col("ceiling").cast("long"), n).alias("next_ceiling"))


def reconciled(findings: DataFrame, items: DataFrame, keys: Sequence[str], verdicts: dict[str, bool]) -> DataFrame:
    """Every finding and every ledger item with a status.

    findings: keys. items: keys, verdict, why, by and seq, their order. verdicts: the known ones, and
    whether they need ``by``. An item is invalid with an unknown verdict, no reason, or no ``by`` where
    one is needed; only valid items excuse findings, one item all equal ones. Of equal items the first
    counts and the others are duplicates; an item that excuses nothing is stale.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    invalid = (
        F.when(~F.coalesce(F.col("verdict"), F.lit("")).isin(*verdicts), "unknown verdict")
        .when(blank("why"), "no reason")
        .when(F.col("verdict").isin(*[v for v, b in verdicts.items() if b]) & blank("by"), "no signer")
    )
    # the first of equal items by a struct minimum joined back: no key's items meet in one sorted group
    first = items.groupBy(*keys).agg(F.min("seq").alias("first_seq"))
    judged = items.join(first, list(keys)).withColumn("fault", F.when(F.col("seq") > F.col("first_seq"), "duplicate").otherwise(invalid))
    valid = judged.filter("fault IS NULL").select(*keys).withColumn("excused", F.lit(True))
    out = findings.join(valid, list(keys), "left").select(*keys, F.lit("finding").alias("side"), F.when(F.col("excused"), "excused").otherwise("open").alias("status"))
    known = findings.select(*keys).distinct().withColumn("met", F.lit(True))
    rows = judged.join(known, list(keys), "left").select(*keys, F.lit("item").alias("side"), F.coalesce("fault", F.when(F.col("met").isNull(), "stale").otherwise("ok")).alias("status"))
    return out.unionByName(rows)
