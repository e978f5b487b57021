"""What two states of a tree lost that kept it honest: tests, assertions, steps, floors; and what they gained to silence it.

Both sides are files (path, text). Equal findings are cancelled copy by copy (matching.unmatched), so a
line that only moved is none. A null or empty text has nothing to lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code, extract, matching

#: Kinds in the order in which a report gives them.
KINDS = ("suppression", "deleted", "test removed", "fewer assertions", "step removed", "floor lowered", "floor removed")


def findings(base: DataFrame, now: DataFrame, rules: tuple[tuple[str, str], ...], is_test: Column, is_ci: Column) -> DataFrame:
    """(kind, path, line, what, detail) of one state against another. is_test and is_ci are conditions on path."""
    row = lambda kind, line, what, detail: [F.lit(kind).alias("kind"), "path", line.cast("int").alias("line"), what.alias("what"), detail.alias("detail")]
    none, no_line = F.lit(None).cast("string"), F.lit(None)
    gained = matching.unmatched(code.suppressions(now, rules), code.suppressions(base, rules), ["path", "rule"], "line")
    gone = base.filter(is_test | F.col("path").rlike(code.SCRIPT) | F.col("path").rlike(r"\.py$")).join(now.select("path"), "path", "left_anti")
    here = now.select("path")
    both = base.join(here, "path", "left_semi")  # what a deleted file had isn't told again
    b_tests, n_tests = code.test_bodies(both.filter(is_test)), code.test_bodies(now.filter(is_test))
    lost = matching.unmatched(b_tests.select("path", "name", "line", "body"), n_tests.select("path", "name", "line"), ["path", "name"], "line")
    # a test that lives on under another name with the same body is no loss
    fresh = matching.unmatched(n_tests.select("path", "name", "line", "body"), b_tests.select("path", "name", "line"), ["path", "name"], "line")
    lost = lost.join(fresh.select("path", "body").distinct(), ["path", "body"], "left_anti")
    fewer = code.assertions(both.filter(is_test)).withColumnRenamed("n", "was").join(code.assertions(now.filter(is_test)), "path", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < was")
    steps = matching.unmatched(extract.ci_steps(both.filter(is_ci)), extract.ci_steps(now.filter(is_ci)), ["path", "identity"], "line")
    before, after = code.floors(both), code.floors(now).groupBy("path", "key").agg(F.min("floor").alias("now_floor"))
    against = before.join(after, ["path", "key"], "left")
    lower, away = against.filter("now_floor < floor"), against.filter("now_floor IS NULL")
    parts = [
        gained.select(*row("suppression", F.col("line"), F.col("rule"), none)),
        gone.select(*row("deleted", no_line, F.col("path"), none)),
        lost.select(*row("test removed", F.col("line"), F.col("name"), none)),
        fewer.select(*row("fewer assertions", no_line, F.col("path"), F.concat_ws(" -> ", F.col("was").cast("string"), F.col("n").cast("string")))),
        steps.select(*row("step removed", F.col("line"), F.col("identity"), none)),
        lower.select(*row("floor lowered", F.col("line"), F.col("key"), F.concat_ws(" -> ", F.col("floor").cast("string"), F.col("now_floor").cast("string")))),
        away.select(*row("floor removed", F.col("line"), F.col("key"), none)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(found: DataFrame, ceilings: DataFrame, readable: Column) -> DataFrame:
    """(kind, n, ceiling, state): FAIL above the ceiling, PASS at or below it, ERROR where it can't be read; readable is a
    condition on ceiling. ceilings (kind, ceiling string) names the kinds told."""
    n = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    rows = ceilings.join(F.broadcast(n), "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # one row for each kind
    state = F.when(~F.coalesce(readable, F.lit(False)), "ERROR").when(F.col("n") > F.col("ceiling").try_cast("long"), "FAIL").otherwise("PASS")
    return rows.select("kind", "n", "ceiling", state.alias("state"))


def since(changed: DataFrame, nodes: DataFrame, was_nodes: DataFrame) -> DataFrame:
    """(path, told): changed names that are nodes now, those that were, and those outside the graph."""
    now, was = nodes.select("path", F.lit(True).alias("now")), was_nodes.select("path", F.lit(True).alias("was"))
    told = F.when(F.col("now"), "changed").when(F.col("was"), "deleted").otherwise("outside")
    return changed.select("path").distinct().join(now, "path", "left").join(was, "path", "left").select("path", told.alias("told"))
