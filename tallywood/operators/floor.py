"""The whole guard of a tree's floor: what a later state of its tests, build steps and settings lost, or gained to silence them.

States are trees (path, text). Only changed files go on, each with both of its texts. Lines are cancelled copy by copy, so a line
that only moved is no finding; lost tests meet new ones of the same body one to one; lines of replaced blocks are aligned in
Arrow batches, file by file, and their numbers are judged by built-in expressions. Every finding says kind, path, line, at_base
(whether the line is that of the earlier state), what and detail.

Defined results: a null text is empty; a text with a NUL is no text and isn't looked at; rows that repeat a path count once;
texts of any length are aligned; an empty tree has no finding.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import alignment, matching, script_source

#: (kind, rule, pattern, files it is read in): our own table; more rows are more rules.
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("suppression added", "linter off", r"#\s*noqa\b|#\s*ruff:\s*noqa|#\s*flake8:\s*noqa", "code"),
    ("suppression added", "type check off", r"#\s*type:\s*ignore|#\s*pyright:\s*ignore|#\s*mypy:\s*ignore-errors", "code"),
    ("suppression added", "pylint off", r"#\s*pylint:\s*disable", "code"),
    ("suppression added", "coverage off", r"#\s*pragma:\s*no\s*cover|\b(?:istanbul|c8|v8)\s+ignore\b", "code"),
    ("suppression added", "security check off", r"#\s*nosec\b|//\s*#nosec\b|nosemgrep", "code"),
    ("suppression added", "eslint off", r"eslint-disable|biome-ignore|oxlint-disable", "code"),
    ("suppression added", "typescript off", r"@ts-(?:ignore|expect-error|nocheck)\b", "code"),
    ("suppression added", "go linter off", r"//\s*nolint\b", "code"),
    ("suppression added", "lint allowed", r"#!?\[allow\(|@SuppressWarnings\b", "code"),
    ("skip added", "pytest skip", r"@pytest\.mark\.(?:skip|skipif|xfail)\b|\bpytest\.(?:skip|xfail|importorskip)\(", "code"),
    ("skip added", "unittest skip", r"@(?:unittest\.)?(?:skip|skipIf|skipUnless|expectedFailure)\b|\bself\.skipTest\(", "code"),
    ("skip added", "script skip", r"\b(?:it|test|describe|suite|context)\.(?:skip|todo|failing)\b|\bx(?:it|test|describe|context)\(", "code"),
    ("skip added", "script only", r"\b(?:it|test|describe|context)\.only\b|\bf(?:it|describe)\(", "code"),
    ("skip added", "go skip", r"\bt\.Skip(?:f|Now)?\(", "code"),
    ("skip added", "rust ignore", r"#\[ignore\b", "code"),
    ("step softened", "failure ignored", r"\bcontinue-on-error:\s*true\b|\ballow_failure:\s*true\b|\bignore_errors:\s*(?:true|yes)\b", "ci"),
    ("step softened", "never run", r"\bif:\s*(?:false\b|\$\{\{\s*false\s*\}\})", "ci"),
    ("step softened", "result dropped", r"\|\|\s*(?:true|:|exit\s+0)(?:\s|$|[\"'])|\bset\s+\+e\b", "ci"),
    ("step softened", "hooks off", r"--no-verify\b", "ci"),
    ("step softened", "script stubbed", r"\"(?:test|lint|check|verify|typecheck|coverage)[\w:-]*\"\s*:\s*\"\s*(?:echo|true|exit\s+0|:)", "ci"),
    ("tests excluded", "ignored by option", r"--ignore(?:-glob)?[=\s]|--deselect[=\s]|--testPathIgnorePatterns\b", "ci or config"),
    ("tests excluded", "selected away", r"(?:^|\s)-k\s*[\"']?\s*not\s|(?:^|\s)-m\s*[\"']?\s*not\s", "ci or config"),
    ("tests excluded", "coverage switched off", r"--no-cov\b|(?:^|\s)-p\s+no:", "ci or config"),
    ("tests excluded", "ignored by setting", r"\b(?:norecursedirs|collect_ignore(?:_glob)?|testPathIgnorePatterns|coveragePathIgnorePatterns|testIgnore)\b", "config"),
    ("tests excluded", "left out by setting", r"^\s*[\"']?(?:omit|exclude)[\"']?\s*[=:]", "config"),
)
# Keys of settings that list what a runner collects.
COLLECTING = ("testpaths", "python_files", "python_classes", "python_functions", "testMatch", "roots", "specPattern", "include")
# Keys of build files whose value is run.
STEP_KEYS = ("run", "uses", "script", "id", "sh", "bat", "entry", "command")
#: Words by which a step, or a script of package.json, is known to check something.
CHECKERS = (
    "ava bandit biome check checks clippy cov coverage cypress e2e eslint flake8 gofmt jest junit ktlint lint mocha mypy nox "
    "phpunit playwright prettier pyright pytest rspec ruff selftest semgrep shellcheck test tests tox tsc typecheck unittest verify vet vitest"
).split()
ASSERTION = r"\bassert\b|\bassert[A-Z_]\w*\(|\bexpect\(|\.should\b|\braises\(|\bt\.(?:Error|Fatal|Fail)"
PROSE = r"(?i)\.(?:md|mdx|markdown|rst|txt|adoc)$"


# Settings of test runners and coverage tools, by name, or by what comes before .config.
CONFIG_FILES = (".coveragerc", ".nycrc", ".nycrc.json", ".mocharc.json", ".mocharc.yml", "codecov.yml", "conftest.py", "karma.conf.js", "package.json", "pyproject.toml", "pytest.ini", "setup.cfg", "tox.ini")
CONFIG_STEMS = ("jest", "playwright", "vite", "vitest")


def is_config(path: Column) -> Column:
    """Whether a path is that of a test runner's or coverage tool's settings."""
    name = F.substring_index(path, "/", -1)
    return name.isin(*CONFIG_FILES) | (F.substring_index(name, ".", 1).isin(*CONFIG_STEMS) & name.rlike(r"\.config\.\w+$"))


def changed(base: DataFrame, now: DataFrame, is_test: Column, is_ci: Column, config: Column) -> tuple[DataFrame, DataFrame]:
    """(changed files, findings on whole files): path, old, new, test, ci, config of each file to be looked at.

    A file that is gone and one that is new are one that moved if their texts are equal; each is taken once, in the order of names. It
    is looked at no further if it still does its job under the new name.
    """
    once = lambda df, out: df.groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias(out)).filter(~F.col(out).contains("\0"))
    was, has = once(base, "old"), once(now, "new")
    flags = {"test": is_test, "ci": is_ci, "config": config}
    both = was.join(has, "path", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    gone = both.filter("new IS NULL").select("path", "old").withColumn("h", F.sha2("old", 256))
    fresh = both.filter("old IS NULL").select("path", "new").withColumn("h", F.sha2("new", 256))
    moved = matching.paired(gone.withColumnRenamed("path", "was_path"), fresh.withColumnRenamed("path", "now_path"), ["h"], "was_path", "now_path")
    told = moved.select(F.col("now_path").alias("path")).withColumns(flags).select(F.col("path").alias("to"), *[F.col(f).alias(f"to_{f}") for f in flags])
    left = gone.join(moved.select(F.col("was_path").alias("path"), F.col("now_path").alias("to")), "path", "left").join(told, "to", "left").withColumns(flags)
    on = F.col("to").isNotNull()
    whole = left.filter("test").select(F.when(on, "test file renamed away").otherwise("test file deleted").alias("kind"), "path", "to", F.coalesce("to_test", F.lit(False)).alias("kept")).filter("NOT kept")
    whole = whole.select("kind", "path", F.lit(None).cast("int").alias("line"), F.lit(True).alias("at_base"), F.coalesce("to", "path").alias("what"), F.lit(None).cast("string").alias("detail"))
    lost = left.filter(~F.col("test") & ~(on & F.coalesce((F.col("to_ci") == F.col("ci")) & (F.col("to_config") == F.col("config")), F.lit(False)))).select("path", "old", F.lit("").alias("new"))
    added = fresh.join(moved.select(F.col("now_path").alias("path")), "path", "left_anti").select("path", F.lit("").alias("old"), "new")
    files = both.filter("old IS NOT NULL AND new IS NOT NULL").unionByName(lost).unionByName(added)
    return files.withColumns(flags), whole


def _lines(files: DataFrame, text: str) -> DataFrame:
    """path, test, ci, config, line, body, said (body without blanks around)."""
    return files.select("path", "test", "ci", "config", F.posexplode(F.split(text, "\r?\n")).alias("at", "body")).select("path", "test", "ci", "config", (F.col("at") + 1).alias("line"), "body", F.regexp_replace("body", r"^\s+|\s+$", "").alias("said")).filter("said <> ''")


def rule_lines(lines: DataFrame, rules: tuple[tuple[str, str, str, str], ...] = RULES) -> DataFrame:
    """(path, line, kind, rule, said) of each rule that a line of a file of its scope matches."""
    scopes = {"code": ~F.col("path").rlike(PROSE), "ci": F.col("ci"), "config": F.col("config"), "ci or config": F.col("ci") | F.col("config")}
    hit = F.filter(F.array(*[F.when(scopes[scope] & F.col("body").rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))) for kind, rule, p, scope in rules]), lambda x: x.isNotNull())
    return lines.select("path", "line", "said", F.explode(hit).alias("r")).select("path", "line", "r.kind", "r.rule", "said")


def _tests(path: str, text: str) -> list[tuple[int, str, str]]:
    """(line, name, body with the name masked) of the tests that a Python, script or Go file declares."""
    if re.search(script_source.SCRIPT, path):
        return [(line, a, b) for kind, line, a, b, _ in script_source.read(text) if kind == "test"]
    lines, out = text.splitlines(), []
    if path.endswith(".go"):
        for i, x in enumerate(lines):
            if m := re.match(r"func\s+(Test\w+)\s*\(", x):
                end = next((k for k in range(i, len(lines)) if lines[k].rstrip() == "}"), i)
                out.append((i + 1, m[1], "\n".join(lines[i : end + 1]).replace(m[1], "\1")))
    elif path.endswith(".py"):
        try:
            nodes = [n for n in ast.walk(ast.parse(text.removeprefix("﻿"))) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test")]
            spans = sorted((n.lineno, n.end_lineno, n.name) for n in nodes)
        except (SyntaxError, ValueError, RecursionError):  # by indentation
            spans = []
            for i, x in enumerate(lines):
                if m := re.match(r"(\s*)(?:async\s+)?def\s+(test\w*)\s*\(", x):
                    held = [k for k in range(i + 1, len(lines)) if lines[k].strip()]
                    inner = next((n for n, k in enumerate(held) if len(lines[k]) - len(lines[k].lstrip()) <= len(m[1])), len(held))
                    spans.append((i + 1, held[inner - 1] + 1 if inner else i + 1, m[2]))
        out = [(a, name, "\n".join(lines[a - 1 : b]).replace(name, "\1")) for a, b, name in spans]
    return out


def tests(files: DataFrame, text: str) -> DataFrame:
    """(path, line, name, body) of every test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *t) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in _tests(p, x or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "line", "name", "body"])

    return files.select("path", text).mapInArrow(run, "path string, line int, name string, body string")


def lost_tests(files: DataFrame) -> DataFrame:
    """(path, line, name, was, has, fresh) of tests that are gone: a name's first copies go, and one whose body lives on under a
    new name isn't lost, each new test answering for one. fresh: names that are new."""
    of = files.filter("test")
    old, new = tests(of, "old"), tests(of, "new")
    count = lambda df, out: df.groupBy("path", "name").agg(F.count(F.lit(1)).alias(out))
    names = count(old, "o").join(count(new, "n"), ["path", "name"], "full").select("path", "name", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("n", F.lit(0)).alias("n"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("path", "name").orderBy("line"))  # equal names of one file
    gone = old.withColumn("nth", nth).join(names.filter("o > n"), ["path", "name"]).filter("nth <= o - n").select("path", "line", "name", "body")
    fresh = new.join(names.filter("n > o"), ["path", "name"]).select("path", F.col("line").alias("new_line"), F.col("name").alias("new_name"), "body")
    twins = matching.paired(gone, fresh, ["path", "body"], "line", "new_line", keep=["path"])
    left = gone.join(twins.select("path", "line"), ["path", "line"], "left_anti")
    others = fresh.join(twins.select("path", "new_line"), ["path", "new_line"], "left_anti").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("new_line", "new_name")))["new_name"].alias("fresh"))
    sizes = names.groupBy("path").agg(F.sum("o").alias("was"), F.sum("n").alias("has"))
    return left.join(sizes, "path").join(others, "path", "left").select("path", "line", "name", "was", "has", F.coalesce("fresh", F.array().cast("array<string>")).alias("fresh"))


def assertions(lines: DataFrame) -> DataFrame:
    """(path, n): assertions of a file, all of a line, comment lines left out."""
    return lines.filter(~F.col("said").rlike(r"^(?:#|//|\*|/\*)")).groupBy("path").agg(F.sum(F.regexp_count("body", F.lit(ASSERTION))).alias("n"))


def steps(files: DataFrame, text: str) -> DataFrame:
    """(path, line, identity, said) of what build files run to check something.

    The identity is the key, or - for a plain list item, and the first check that is named, so an option more is no other
    step. Scripts of package.json go by their name, if a word of it is one of CHECKERS.
    """
    of = files.filter("ci")
    package = F.col("path").rlike(r"(?:^|/)package\.json$")
    lines = _lines(of.filter(~package), text).filter(~F.col("said").startswith("#"))
    key = F.regexp_extract("body", rf"^[\s-]*({'|'.join(STEP_KEYS)})\b:?\s", 1)
    item = F.col("body").rlike(r"^\s*-\s") & ~F.col("body").rlike(r"^\s*-\s+[\w.-]+:(?:\s|$)")
    value = F.when(key != "", F.regexp_replace("body", rf"^[\s-]*(?:{'|'.join(STEP_KEYS)})\b:?\s", "")).otherwise(F.col("body"))
    check = F.get(F.filter(F.regexp_extract_all(F.lower(value), F.lit(r"(\w+)"), 1), lambda w: w.isin(*CHECKERS)), 0)
    plain = lines.withColumn("identity", F.concat_ws(":", F.when(key != "", key).when(item, "-"), check)).filter(((key != "") | item) & check.isNotNull())
    form = r"^\s*\"([\w:.-]+)\"\s*:\s*\"([^\"]*)\""
    scripts = _lines(of.filter(package), text).withColumns({"identity": F.regexp_extract("body", form, 1), "run": F.regexp_extract("body", form, 2)})
    # a dependency has a version, or a place to come from
    known = scripts.filter(F.arrays_overlap(F.split("identity", r"[\W_]+"), F.array(*map(F.lit, CHECKERS))) & ~F.col("run").rlike(r"^(?:[^A-Za-z]|[a-z]+:)"))
    return plain.select("path", "line", "identity", "said").unionByName(known.select("path", "line", "identity", "said"))


def key_before(before: Column) -> Column:
    """The identifier just before a number, over three other characters at most.

    ``([A-Za-z_][\\w.-]*)\\W{0,3}$`` read from the end, so a line of one long word is gone through once.
    """
    return F.reverse(F.regexp_extract(F.reverse(before), r"^[\r\u0085\u2028\u2029]?\W{0,3}?([\w.-]*[A-Za-z_])", 1))


def bounds(text: Column) -> Column:
    """For each number of a line: its value, its key, and which way it loosens (up, down or null)."""
    parts = F.split(text, T.NUMBER)
    # a column that is made once: within the function the line would be split again for each of its numbers
    each = F.filter(F.arrays_zip(T.numbers(text).alias("value"), parts.alias("before"), F.slice(parts, 2, F.size(parts)).alias("after")), lambda x: x["value"].isNotNull())
    return F.transform(each, lambda x: F.struct(x["value"].alias("value"), key_before(x["before"]).alias("key"), T.direction(key_before(x["before"]), x["before"], x["after"]).alias("way")))


def aligned(files: DataFrame) -> DataFrame:
    """(path, line, new_line, old_said, new_said): lines of replaced blocks that differ in their numbers alone.

    A block's earlier lines take the first later line of the same skeleton, each once. The blocks are difflib's, of files of any length.
    """
    number = re.compile(T.NUMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, old, new in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                before, after = old.splitlines(), new.splitlines()
                for i1, i2, j1, j2 in alignment.replaced(before, after):
                    free: dict[str, list[int]] = {}
                    for j in reversed(range(j1, j2)):
                        free.setdefault(number.sub("#", after[j]).strip(), []).append(j)
                    for i in range(i1, i2):
                        bare = number.sub("#", before[i]).strip()
                        if "#" in bare and free.get(bare):
                            j = free[bare].pop()
                            rows.append((path, i + 1, j + 1, before[i].strip(), after[j].strip()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "line", "new_line", "old_said", "new_said"])

    return files.filter("old <> '' AND new <> ''").select("path", "old", "new").mapInArrow(run, "path string, line int, new_line int, old_said string, new_said string")


def loosened(pairs: DataFrame) -> DataFrame:
    """Those of aligned's pairs in which a number went the way that its line calls looser."""
    pairs = pairs.withColumns({"o": bounds(F.col("old_said")), "n": bounds(F.col("new_said"))})
    worse = F.zip_with("o", "n", lambda a, b: ((b["way"] == "up") & (b["value"] > a["value"])) | ((b["way"] == "down") & (b["value"] < a["value"])))
    return pairs.filter(F.exists(worse, lambda x: F.coalesce(x, F.lit(False)))).drop("o", "n")


def lost_floors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line, said): lines that set a number its key calls a floor, gone with their key from the whole file."""
    floor = F.filter(bounds(F.col("said")), lambda x: x["way"] == "down")
    rows = old.filter("ci OR config").withColumn("f", floor).filter(F.size("f") > 0).select("path", "line", "said", F.get("f", 0)["key"].alias("key"))
    left = matching.unmatched(rows, new.filter("ci OR config").select("path", "said"), ["path", "said"], "line")
    words = new.filter("ci OR config").select("path", F.explode(F.regexp_extract_all("body", F.lit(r"([\w.-]+)"), 1)).alias("key")).distinct()
    return left.join(words, ["path", "key"], "left_anti").select("path", "line", "said")


def collected(lines: DataFrame) -> DataFrame:
    """(path, key, line, entries): what lines ``key = a, "b"`` of settings list, over all lines of a key, and the last such line."""
    form = rf"^\s*[\"']?({'|'.join(COLLECTING)})[\"']?\s*[=:]\s*(\S.*)$"
    entry = F.regexp_extract_all(F.regexp_extract("body", form, 2), F.lit(r"([^\s,\"'\[\]()]+)"), F.lit(1))
    return lines.filter("config").filter(F.col("body").rlike(form)).select("path", F.regexp_extract("body", form, 1).alias("key"), "line", F.explode_outer(entry).alias("e")).groupBy("path", "key").agg(F.max("line").alias("line"), F.array_sort(F.collect_set("e")).alias("entries"))


def findings(base: DataFrame, now: DataFrame, is_test: Column, is_ci: Column, config: Column, rules: tuple[tuple[str, str, str, str], ...] = RULES, stage=None) -> DataFrame:
    """kind, path, line, at_base, what, detail of all that now lost or gained against base. The conditions are on path."""
    from .graph import cut

    files, whole = changed(base, now, is_test, is_ci, config)
    files = (stage or cut)(files)
    old, new = _lines(files, "old"), _lines(files, "new")
    c = F.col

    def rows(df: DataFrame, kind: Column, at_base: bool, line: Column, what: Column, detail: Column) -> DataFrame:
        return df.select(kind.alias("kind"), "path", line.cast("int").alias("line"), F.lit(at_base).alias("at_base"), what.alias("what"), detail.cast("string").alias("detail"))

    none, lit = F.lit(None), F.lit
    keys = ["path", "kind", "rule", "said"]
    gained = matching.unmatched(rule_lines(new, rules), rule_lines(old, rules).select(*keys), keys, "line")
    tests_gone = lost_tests(files)
    more = F.when(F.size("fresh") > 3, F.concat(lit(" +"), (F.size("fresh") - 3).cast("string"), lit(" more"))).otherwise("")
    hint = F.when(F.size("fresh") > 0, F.concat(lit("; new here: "), F.array_join(F.slice("fresh", 1, 3), ", "), more)).otherwise("")
    fewer = assertions(old.filter("test")).withColumnRenamed("n", "was").join(assertions(new.filter("test")), "path", "left").withColumn("n", F.coalesce("n", lit(0))).filter("n < was")
    numbers = F.concat_ws(" -> ", c("was").cast("string"), c("n").cast("string"))
    steps_gone = matching.unmatched(steps(files, "old"), steps(files, "new").select("path", "identity"), ["path", "identity"], "line")
    lists = collected(old).select("path", "key", c("entries").alias("had")).join(collected(new), ["path", "key"]).withColumn("lost", F.array_except("had", "entries")).filter("size(lost) > 0")
    pairs = loosened(aligned(files.filter("test OR ci OR config")))
    out = [
        rows(gained, c("kind"), False, c("line"), c("said"), c("rule")),
        rows(tests_gone, lit("test removed"), True, c("line"), c("name"), F.concat(c("was").cast("string"), lit(" -> "), c("has").cast("string"), hint)),
        rows(fewer, lit("assertions dropped"), False, none, numbers, none),
        rows(steps_gone, lit("step removed"), True, c("line"), c("said"), c("identity")),
        rows(lists, lit("tests excluded"), False, c("line"), F.concat(c("key"), lit(" no longer lists "), F.array_join("lost", ", ")), none),
        rows(lost_floors(old, new), lit("threshold loosened"), True, c("line"), F.concat(c("said"), lit(" -> (removed)")), none),
        rows(pairs, lit("threshold loosened"), False, c("new_line"), F.concat_ws(" -> ", "old_said", "new_said"), none),
    ]
    for x in out:
        whole = whole.unionByName(x)
    return whole


def notes(base: DataFrame, now: DataFrame, most: int | None = None) -> DataFrame:
    """(path, note): files that can't be looked at in full, as they are no text, and those over most characters, if a caller leaves these out of aligned."""
    both = base.select("path", "text").unionByName(now.select("path", "text")).groupBy("path").agg(F.max(F.length("text")).alias("n"), F.bool_or(F.coalesce(F.col("text").contains("\0"), F.lit(False))).alias("binary"))
    return both.select("path", F.when(F.col("binary"), "no text").when(F.col("n") > F.lit(most), "counted, but not aligned").alias("note")).filter("note IS NOT NULL")
