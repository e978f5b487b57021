"""Histories as graphs: ancestors, merge bases, the tree at a commit, and the versions of a path.

parents: (commit, parent), a row for each parent. A commit lies on one branch, at a place; of a branch, each commit was made, in
some steps, from those at smaller places, so what a root was made from is, of every branch, all up to one place. Only where a parent lies
on another branch is there a crossing: (branch, at, to, to_at). Ancestors are found by jumps over 1, 2, 4, … crossings: as many
joins as the most crossings on a way have binary digits, twice. Where branches aren't told, each commit is one by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def first_reaching(jump: DataFrame) -> DataFrame:
    """The rows of jump (branch, at, to, to_at) that reach further than all those from smaller places of the branch."""
    best = jump.groupBy("branch", "to", "at").agg(F.max("to_at").alias("to_at"))
    before = Window.partitionBy("branch", "to").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("had", F.max("to_at").over(before)).filter("had IS NULL OR had < to_at").select("branch", "at", "to", "to_at")


def reach(crossings: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, branch, at): the place up to which each branch belongs to what root was made from. heads: (root, branch, at), where each root lies."""
    jump = cut(first_reaching(crossings))
    jumps = []
    while jump.limit(1).count():
        jumps.append(jump)
        onward = jump.select(F.col("branch").alias("to"), F.col("at").alias("from"), F.col("to").alias("further"), F.col("to_at").alias("further_at"))
        twice = jump.join(onward, "to").filter("from <= to_at")
        jump = cut(first_reaching(twice.select("branch", "at", F.col("further").alias("to"), F.col("further_at").alias("to_at"))))
    reached = heads.select("root", "branch", "at").distinct()
    for j in reversed(jumps):  # every number of crossings is a sum of such jumps
        step = j.select("branch", F.col("at").alias("from"), "to", "to_at")
        more = reached.join(step, "branch").filter("from <= at").select("root", F.col("to").alias("branch"), F.col("to_at").alias("at"))
        reached = cut(reached.unionByName(more).groupBy("root", "branch").agg(F.max("at").alias("at")))
    return reached


def alone(parents: DataFrame) -> DataFrame:
    """The crossings of parents where each commit is a branch by itself."""
    known = parents.filter("commit IS NOT NULL AND parent IS NOT NULL")
    return known.select(F.col("commit").alias("branch"), F.lit(0).alias("at"), F.col("parent").alias("to"), F.lit(0).alias("to_at"))


def ancestors(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, commit): every commit from which root was made, itself included, for the distinct roots (root)."""
    heads = roots.select("root", F.col("root").alias("branch"), F.lit(0).alias("at"))
    return reach(alone(parents), heads).select("root", F.col("branch").alias("commit"))


def merge_bases(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, base) for each pair (left, right): the common ancestors that no other common ancestor was made from.

    Pairs without a common ancestor have no row; of several bases all are told.
    """
    roots = pairs.select(F.col("left").alias("root")).union(pairs.select("right"))
    heads = roots.select("root", F.col("root").alias("branch"), F.lit(0).alias("at"))
    return branch_bases(alone(parents), heads, pairs).select("left", "right", F.col("branch").alias("base"))


def branch_bases(crossings: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, branch, at): the places of the merge bases of each pair (left, right) of roots of heads (root, branch, at).

    What both were made from is, of every branch, all up to the lesser of two places. Common ancestors are closed under
    parents, so a base is the last of them on its branch, unless a crossing from a common ancestor leads to it.
    """
    up = reach(crossings, heads)
    side = lambda c, at: up.select(F.col("root").alias(c), "branch", F.col("at").alias(at))
    both = pairs.select("left", "right").distinct().join(side("left", "a"), "left").join(side("right", "b"), ["right", "branch"])
    common = cut(both.select("left", "right", "branch", F.least("a", "b").alias("at")))
    step = crossings.select("branch", F.col("at").alias("from"), "to", "to_at")
    above = common.join(step, "branch").filter("from <= at").select("left", "right", F.col("to").alias("branch"), F.col("to_at").alias("at")).distinct()
    return common.join(above, ["left", "right", "branch", "at"], "left_anti")


def seen_from(crossings: DataFrame, heads: DataFrame, changes: DataFrame) -> DataFrame:
    """(root, …): the changes (branch, at, …) of all commits from which each root of heads was made."""
    up = reach(crossings, heads).withColumnRenamed("at", "last")
    return up.join(changes, "branch").filter("at <= last").drop("branch", "at", "last")


def resolved_base(asked: DataFrame, refs: DataFrame, order: tuple[str, ...] = ("upstream", "main", "master")) -> DataFrame:
    """asked (id, given) with name and commit: the ref that is given, else the first of order that refs (name, commit) has.

    A given name that no ref has is refused: its row has the name and no commit, whatever else exists.
    """
    tries = F.when(F.col("given").isNotNull(), F.array("given")).otherwise(F.array(*map(F.lit, order)))
    tried = asked.select("id", F.posexplode(tries).alias("nth", "name")).join(refs.select("name", "commit"), "name")
    first = tried.groupBy("id").agg(F.min_by(F.struct("name", "commit"), "nth").alias("m"))
    return asked.join(first, "id", "left").select(*asked.columns, F.coalesce("m.name", "given").alias("name"), F.col("m.commit").alias("commit"))


def tree_at(parents: DataFrame, changes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, text, commit): the tree at each root. changes: (commit, seq, path, text), a null text where the path goes.

    seq numbers the commits so that parents come first; a path has its last version among the root's ancestors.
    """
    return last_versions(ancestors(parents, roots).join(changes, "commit"))


def last_versions(seen: DataFrame) -> DataFrame:
    """(root, path, text, commit): of the changes seen (root, commit, seq, path, text) from each root, the last of each path."""
    last = seen.groupBy("root", "path").agg(F.max(F.struct("seq", "commit", "text")).alias("m"))
    return last.select("root", "path", "m.text", "m.commit").filter("text IS NOT NULL")


def path_versions(parents: DataFrame, changes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, nth, commit, blob): the versions of every path up to each root, the newest first; blob is git's id of the text."""
    return all_versions(ancestors(parents, roots).join(changes, "commit"))


def all_versions(seen: DataFrame) -> DataFrame:
    """(root, path, nth, commit, blob) of the changes seen (root, commit, seq, path, text) from each root."""
    from ..functions.text import blob_id

    nth = F.row_number().over(Window.partitionBy("root", "path").orderBy(F.desc("seq")))  # the versions of one path
    return seen.filter("text IS NOT NULL").select("root", "path", nth.cast("long").alias("nth"), "commit", blob_id(F.encode("text", "UTF-8")).alias("blob"))
