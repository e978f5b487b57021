"""Source files (path, text) to references of scripts and prose, tests and steps, by built-in expressions.

Files are read line by line; python_source reads Python by its syntax. A null or empty text has no line. References are resolved by joins: a name that one file answers to is an edge,
a name that several answer to is ambiguous, and any other is external.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, ending: str | None = None) -> DataFrame:
    """(path, line from 1, body) of files whose path matches ending; a byte-order mark is no part of the first line."""
    rows = files if ending is None else files.filter(F.col("path").rlike(ending))
    parts = F.split(F.regexp_replace("text", "^\\uFEFF", ""), "\r?\n")
    return rows.select("path", F.posexplode(parts).alias("at", "body")).select("path", (F.col("at") + 1).alias("line"), "body")


def _word(body: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))


def _all(kind: str, pattern: str, name: str) -> Column:
    """An array of (kind, name) for each match of pattern in a line."""
    return F.transform(F.regexp_extract_all("body", F.lit(pattern), 1), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias(name)))


#: Files a task resolves references to.
FILES_A_TASK = 50_000
SCRIPT = r"\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$"


def script_references(files: DataFrame) -> DataFrame:
    """(path, line, kind, spec): imports, re-exports, require and dynamic imports of JavaScript and TypeScript files; comment lines are skipped."""
    q = r"['\"`]([^'\"`]+)['\"`]"
    rows = lines(files, SCRIPT).filter(~F.col("body").rlike(r"^\s*(?://|\*|/\*)"))
    kinds = {"import": rf"^\s*import\s+(?:[^'\"`()]*\sfrom\s+)?{q}", "reexport": rf"^\s*export\s[^'\"`]*\sfrom\s+{q}", "require": rf"\brequire\(\s*{q}\s*\)", "dynamic-import": rf"\bimport\(\s*{q}\s*\)"}
    found = F.concat(*[_all(k, p, "spec") for k, p in kinds.items()])
    return rows.select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def joined_path(folder: Column, spec: Column) -> Column:
    """folder/spec without ``.`` and ``..`` parts; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    done = F.aggregate(parts, start, lambda a, p: F.when(p == "..", F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["out"] | (F.size(a["p"]) == 0)).alias("out"))).otherwise(F.struct(F.concat(a["p"], F.array(p)).alias("p"), a["out"].alias("out"))))
    return F.when(~done["out"], F.array_join(done["p"], "/"))


def script_edges(files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json", "/index.ts", "/index.js")) -> DataFrame:
    """(src, dst, kind, line): relative references resolved to the first file that exists; dst is null where none does.

    Files tell what they can be called by, each name's best file is taken, and a reference asks once. Paths and references are so alike that
    their shuffles look small, so the number of tasks follows that of the files and isn't left to the bytes.
    """
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    refs = script_references(files).filter(F.col("spec").rlike(r"^\.\.?/")).withColumn("base", joined_path(folder, F.col("spec")))
    refs = refs.select("base", "path", "line", "kind", "spec").repartition(parts, "base").distinct()
    names = [F.when(F.endswith("path", F.lit(e)), F.struct(F.expr(f"substring(path, 1, length(path) - {len(e)})").alias("base"), F.lit(i).alias("rank"))) for i, e in enumerate(endings)]
    held = files.select("path", F.explode(F.array_compact(F.array(*names))).alias("n")).select("n.*", F.col("path").alias("target"))
    best = held.repartition(parts, "base").groupBy("base").agg(F.min(F.struct("rank", "target")).alias("m"))
    return refs.join(best, "base", "left").select(F.col("path").alias("src"), F.col("m.target").alias("dst"), "kind", "line")


def test_bodies(files: DataFrame) -> DataFrame:
    """(path, line, name, body) of Python tests: the lines below the name that are indented or blank, up to the next test or other code."""
    rows = lines(files, r"\.py$")
    name = _word(F.col("body"), r"^(?:async\s+)?def\s+(test\w*)")
    edge = F.col("body").rlike(r"^\S")
    parts = rows.withColumn("name", name).withColumn("opens", F.when(edge, F.col("line")))
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = parts.withColumn("at", F.max("opens").over(w)).filter("at IS NOT NULL")
    of = held.groupBy("path", F.col("at").alias("line")).agg(F.max(F.when(F.col("line") == F.col("at"), F.col("name"))).alias("name"), F.sort_array(F.collect_list(F.when(F.col("line") > F.col("at"), F.struct("line", "body")))).alias("b"))
    return of.filter("name IS NOT NULL").select("path", "line", "name", F.array_join("b.body", "\n").alias("body"))


def assertions(files: DataFrame) -> DataFrame:
    """(path, n): assertions in a test file, all of a line, comment lines skipped."""
    rows = lines(files, r"\.(?:py|js|ts|tsx)$").filter(~F.col("body").rlike(r"^\s*(?:#|//|\*)"))
    return rows.groupBy("path").agg(F.sum(F.regexp_count("body", F.lit(r"\bassert\w*\b|\bexpect\("))).alias("n")).filter("n > 0")


def frontmatter(files: DataFrame) -> DataFrame:
    """(path, key, value, style): the top-level keys between a file's first two ``---`` lines; style is plain, quoted, block or mapping."""
    head = F.regexp_extract("text", r"(?s)^﻿?---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1)
    rows = files.filter(F.col("path").rlike(r"\.mdx?$")).select("path", F.explode(F.split(head, "\r?\n")).alias("body")).filter(F.col("body").rlike(r"^[A-Za-z_][\w-]*\s*:"))
    raw = F.trim(F.regexp_extract("body", r"^[^:]*:(.*)$", 1))
    style = F.when(raw == "", "mapping").when(raw.rlike(r"^[|>][+-]?$"), "block").when(raw.rlike(r"^(['\"]).*\1$"), "quoted").otherwise("plain")
    value = F.when(style == "quoted", F.expr("substring(raw, 2, length(raw) - 2)")).when(style == "plain", F.col("raw"))
    return rows.withColumn("raw", raw).select("path", F.regexp_extract("body", r"^([A-Za-z_][\w-]*)", 1).alias("key"), value.alias("value"), style.alias("style"))


def markdown_references(files: DataFrame) -> DataFrame:
    """(path, line, kind, target): inline links, reference definitions and wikilinks outside fences and code spans; images apart."""
    from pyspark.sql import Window

    rows = lines(files, r"\.mdx?$")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("body").rlike(r"^\s*```")
    out = rows.withColumn("n", F.count_if(fence).over(w)).filter((F.col("n") % 2 == 0) & ~fence).withColumn("body", F.regexp_replace("body", "`[^`]*`", ""))
    kinds = {"link": r"(?<!!)\[[^\]\[]*\]\(([^)\s]+)", "reference": r"^\s*\[[^\]]+\]:\s*(\S+)", "wikilink": r"\[\[([^\]|#]+)"}
    found = F.concat(*[_all(k, p, "target") for k, p in kinds.items()])
    return out.select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def suppressions(files: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(path, line, rule): lines that a pattern of rules (name, pattern) matches, each rule once a line."""
    some = "|".join(f"(?:{p})" for _, p in rules)
    rows = lines(files).filter(F.col("body").rlike(some))
    hit = F.filter(F.array(*[F.when(F.col("body").rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())
    return rows.select("path", "line", F.explode(hit).alias("rule"))


def floors(files: DataFrame) -> DataFrame:
    """(path, line, key, floor): numbers set for keys that name a floor: minimum, least, threshold, coverage, fail_under."""
    rows = lines(files, r"\.(?:ya?ml|toml|cfg|ini|json|py)$")
    p = r"(?i)^\s*['\"]?([\w.-]*(?:min|floor|least|threshold|coverage|fail_under)[\w.-]*)['\"]?\s*[:=]\s*(-?\d+(?:\.\d+)?)\b"
    return rows.withColumn("key", F.regexp_extract("body", p, 1)).filter("key <> ''").select("path", "line", "key", F.regexp_extract("body", p, 2).cast("double").alias("floor"))


def located(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, how, path, candidates): a name is a whole path, else the end of one at a slash; ambiguous and unknown ones have no path."""
    parts = F.split("path", "/")
    ends = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat_ws("/", F.slice(parts, i, F.size(parts))).alias("name"), (i == 1).alias("whole")))).alias("n")).select("path", "n.*")
    best = ends.groupBy("name").agg(F.max(F.when(F.col("whole"), F.col("path"))).alias("whole_path"), F.count(F.lit(1)).alias("n"), F.min("path").alias("any_path"))
    how = F.when(F.col("whole_path").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    path = F.coalesce("whole_path", F.when(F.col("n") == 1, F.col("any_path")))
    return asked.join(best, "name", "left").select("name", how.alias("how"), path.alias("path"), F.coalesce("n", F.lit(0)).alias("candidates"))
