"""Multiset differences, one-to-one matches, unique matches and token similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import notes


def unmatched(now: DataFrame, base: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of now beyond as many as base has of the same keys: the first ones cancel, later ones stay.

    Only keys that base has are numbered; the window is over equal rows of one file.
    """
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__base"))
    w = Window.partitionBy(*keys).orderBy(order)
    return now.withColumn("__n", F.row_number().over(w)).join(counts, list(keys), "left").filter(F.col("__n") > F.coalesce("__base", F.lit(0))).drop("__n", "__base")


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """(left_id, right_id) and the keys to keep: equal rows matched one to one, each once, in the order of their ids."""
    a = left.select(*keys, left_id, F.row_number().over(Window.partitionBy(*keys).orderBy(left_id)).alias("__n"))
    b = right.select(*keys, right_id, F.row_number().over(Window.partitionBy(*keys).orderBy(right_id)).alias("__n"))
    return a.join(b, [*keys, "__n"]).select(*keep, left_id, right_id)


def resolved(refs: DataFrame, targets: DataFrame, key: str, ref: str, target: str) -> DataFrame:
    """refs with the one target of their key: ``external`` without any, ``edge`` with one, ``ambiguous`` with more."""
    known = targets.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.min(target).alias("__t"))
    n = F.coalesce("candidates", F.lit(0))
    return refs.join(known, key, "left").select(ref, key, n.alias("candidates"), F.when(n == 0, "external").when(n == 1, "edge").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("__t")).alias(target))


def prioritized(refs: DataFrame, files: DataFrame, candidates: str, path: str, ref: str) -> DataFrame:
    """(ref, path, nth): the first of each reference's candidates that exists."""
    tried = refs.select(ref, F.posexplode(candidates).alias("nth", path))
    met = tried.join(files.select(path).distinct(), path)
    return met.groupBy(ref).agg(F.min(F.struct("nth", path)).alias("m")).select(ref, F.col(f"m.{path}").alias(path), F.col("m.nth").alias("nth"))


def token_candidates(left: DataFrame, right: DataFrame, share: float = 0.15, shared: int = 5) -> DataFrame:
    """(l, r): every pair (id, tokens) with a jaccard of share or more, or with shared tokens in common or more, and some others.

    Tokens that only one side has are in no pair and are left out first. The others are ordered from the rarest to the commonest. Two
    sets that have k in common meet within the first m - k + 1 of the m tokens that each has left, so a set is looked up by
    its rarest tokens alone, and the commonest ones, which make most of the pairs, by none; one of fewer than k has no pair.
    """
    words = lambda df, side: df.select(F.col("id"), F.lit(side).alias("side"), F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    each = words(left, "l").unionAll(words(right, "r"))
    known = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("side").alias("hi"), F.min("side").alias("lo")).filter("lo <> hi").select("t", "df")
    least = F.least(F.ceil(F.lit(share) * F.col("n")), F.lit(shared)).cast("int")
    few = each.join(known, "t").groupBy("side", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("w"))
    few = few.withColumn("t", F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - F.greatest(least, F.lit(1)) + 1, F.lit(0)))["t"])).select("side", "id", "n", "t")
    a = few.filter("side = 'l'").select(F.col("id").alias("l"), F.col("n").alias("ln"), "t")
    b = few.filter("side = 'r'").select(F.col("id").alias("r"), F.col("n").alias("rn"), "t")
    # a smaller set can't reach the share, unless it can reach the number
    fits = (F.least("ln", "rn") >= F.lit(share) * F.greatest("ln", "rn")) | (F.least("ln", "rn") >= shared)
    return a.join(b, "t").filter(fits).select("l", "r").distinct()


def _measured(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (l, r) with the columns of both sides (a struct each), all, shared, jaccard and overlap."""
    side = lambda df, n: df.select(F.col("id").alias(n), F.struct(*df.columns).alias(f"{n}_row"))
    both = pairs.join(side(left, "l"), "l").join(side(right, "r"), "r").withColumn("all", F.array_sort(F.array_intersect("l_row.tokens", "r_row.tokens")))
    ln, rn, n = F.size("l_row.tokens"), F.size("r_row.tokens"), F.size("all")
    return both.withColumns({"shared": n.cast("long"), "jaccard": F.coalesce(F.try_divide(n, ln + rn - n), F.lit(0.0)), "overlap": F.coalesce(F.try_divide(n, F.least(ln, rn)), F.lit(0.0))})


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, shared, jaccard, overlap, kind, shared_tokens) of pairs that are duplicates or siblings by their tokens.

    left, right: id, tokens (a set). duplicate from a jaccard of 0.35, or an overlap of 0.6 with 8 shared; sibling from 0.15,
    or 0.4 with 5. The kind is decided before rounding.
    """
    j, o, n = F.col("jaccard"), F.col("overlap"), F.col("shared")
    kind = F.when((j >= 0.35) | ((o >= 0.6) & (n >= 8)), "duplicate").when((j >= 0.15) | ((o >= 0.4) & (n >= 5)), "sibling")
    pairs = _measured(token_candidates(left, right), left, right)
    return pairs.withColumn("kind", kind).filter("kind IS NOT NULL").select("l", "r", "shared", F.round(j, 3).alias("jaccard"), F.round(o, 3).alias("overlap"), "kind", F.slice("all", 1, 12).alias("shared_tokens"))


def name_candidates(left: DataFrame, right: DataFrame, long: int = 5) -> DataFrame:
    """(l, r): every pair (id, name) of equal names, of one with more than long characters within the other, or with two parts in common.

    A name within another begins with one of its runs of long + 1 characters; two common parts are one common pair of parts.
    """
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - long, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(long + 1)))
    parts = F.array_sort(F.array_except(F.array_distinct(F.split("name", "-")), F.array(*map(F.lit, notes.NEVER_SHARED))))
    two = F.flatten(F.transform(parts, lambda x, i: F.transform(F.slice(parts, i + 2, F.size(parts)), lambda y: F.concat_ws(" - ", x, y))))
    out = left.select(F.col("id").alias("l"), "name").join(right.select(F.col("id").alias("r"), "name"), "name").select("l", "r")
    for a, b, m, n in ((left, right, "l", "r"), (right, left, "r", "l")):
        heads = a.filter(F.length("name") > long).select(F.col("id").alias(m), F.col("name").alias("inner"), F.substring("name", 1, long + 1).alias("g"))
        held = b.select(F.col("id").alias(n), "name", F.explode(F.array_distinct(grams)).alias("g"))
        out = out.unionByName(heads.join(held, "g").filter(F.col("name").contains(F.col("inner"))).select("l", "r"))
    pair = lambda df, n: df.select(F.col("id").alias(n), F.explode(two).alias("two"))
    return out.unionByName(pair(left, "l").join(pair(right, "r"), "two").select("l", "r")).distinct()


def related(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, kind, jaccard, overlap, shared_tokens, shared_triggers, same_name) of all pairs that are of one kind.

    left, right: id, name, tokens and triggers (sets). duplicate: the same name, a shared trigger with a jaccard of 0.2, or by
    tokens as in similar; sibling: names that hit (notes.name_hit), a shared trigger, or by tokens. Pairs are found by their
    rarest tokens, by triggers and by names, each with an equi-join, and measured once.
    """
    said = lambda df, n: df.select(F.col("id").alias(n), F.explode("triggers").alias("t"))
    by_trigger = said(left, "l").join(said(right, "r"), "t").select("l", "r")
    pairs = token_candidates(left, right).unionByName(by_trigger).unionByName(name_candidates(left, right)).distinct()
    j, o, n = F.col("jaccard"), F.col("overlap"), F.col("shared")
    rows = _measured(pairs, left, right).withColumn("triggers", F.array_sort(F.array_intersect("l_row.triggers", "r_row.triggers")))
    some, same = F.size("triggers") > 0, F.col("l_row.name") == F.col("r_row.name")
    hit = notes.name_hit(F.col("l_row.name"), F.col("r_row.name"), j, some)
    kind = F.when(same | (some & (j >= 0.2)) | (j >= 0.35) | ((o >= 0.6) & (n >= 8)), "duplicate").when(hit | some | (j >= 0.15) | ((o >= 0.4) & (n >= 5)), "sibling")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("l", "r", "kind", F.round(j, 3).alias("jaccard"), F.round(o, 3).alias("overlap"), F.slice("all", 1, 12).alias("shared_tokens"), F.col("triggers").alias("shared_triggers"), same.alias("same_name"))


def collated(pairs: DataFrame) -> DataFrame:
    """related's pairs with place: duplicates first, then by the rounded jaccard, then by l and r."""
    from .graph import ranked

    return ranked(pairs.withColumns({"second": F.col("kind") != "duplicate", "less": -F.col("jaccard")}), ["second", "less", "l", "r"], "place").drop("second", "less")
