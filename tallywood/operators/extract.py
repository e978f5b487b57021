"""Extractors: files (path, text) to rows, by built-in expressions. Each reads a file by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(files: DataFrame, pattern: str, group: int = 1, text: str = "text") -> DataFrame:
    return files.select("path", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), group)).alias("nth", "name"))


def page_routes(files: DataFrame) -> DataFrame:
    """(path, route): pages by their place below ``app``, ``pages`` or ``src/pages``; ``pages/api`` isn't one."""
    stem = F.regexp_extract("path", r"^(?:src/)?(?:app/(?:(.*)/)?page|pages/(.*))\.(?:js|jsx|ts|tsx|astro|md|mdx)$", 0)
    inner = F.coalesce(F.nullif(F.regexp_extract("path", r"^(?:src/)?app/(.*)/page\.\w+$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"^(?:src/)?pages/(.*)\.\w+$", 1), F.lit("")), F.lit(""))
    fixed = F.regexp_replace(F.regexp_replace(inner, r"\([^)]*\)/?", ""), "(^|/)index$", "")
    return files.filter((stem != "") & ~F.col("path").rlike(r"^(?:src/)?pages/(?:api/|_)")).select("path", F.concat(F.lit("/"), F.rtrim(fixed, F.lit("/"))).alias("route"))


def express_routes(files: DataFrame) -> DataFrame:
    """(path, nth, method, route) of calls such as ``app.get('/x', …)``."""
    call = r"\b(?:app|router)\.((?:get|post|put|patch|delete)\(\s*['\"`][^'\"`]+)"
    rows = _found(files.filter(F.col("text").contains("(")), call)
    return rows.select("path", "nth", F.upper(F.regexp_extract("name", r"^(\w+)", 1)).alias("method"), F.regexp_extract("name", r"['\"`](.*)$", 1).alias("route"))


def package_scripts(files: DataFrame) -> DataFrame:
    """(path, name, command) of ``package.json`` files at the root or one folder below."""
    own = files.filter(F.col("path").rlike(r"^(?:[^/]+/)?package\.json$"))
    parsed = F.from_json("text", "scripts map<string,string>")
    return own.select("path", F.explode(parsed["scripts"]).alias("name", "command"))


def environment_names(files: DataFrame) -> DataFrame:
    """(path, name) of the environment variables a file reads; values are never taken."""
    read = r"(?:os\.environ(?:\.get)?[\[(]\s*|os\.getenv\(\s*|process\.env(?:\.|\[\s*))['\"]?([A-Z][A-Z0-9_]*)"
    return _found(files.filter(F.col("text").rlike("environ|getenv|process")), read).select("path", "name").distinct()


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, line, target) of links outside code and comments, images apart.

    What is blanked keeps its newlines, so lines are those of the file.
    """

    def blanked(text: Column, opened: str, closed: str) -> Column:
        """text with blanks for what stands between the marks: every second part where both are the same."""
        parts = F.split(text, opened)
        inside = (lambda p, i: i % 2 == 1) if opened == closed else (lambda p, i: i > 0)

        def clean(p: Column, i: Column) -> Column:
            end = F.position(F.lit(closed), p)
            hidden = p if opened == closed else F.when(end > 0, F.substring(p, F.lit(1), end - 1)).otherwise(p)
            rest = F.lit("") if opened == closed else F.when(end > 0, F.substring(p, end, F.length(p))).otherwise("")
            return F.when(inside(p, i), F.concat(F.regexp_replace(hidden, "[^\n]", " "), rest)).otherwise(p)

        return F.array_join(F.transform(parts, clean), opened)

    blank = blanked(blanked(F.col("text"), "```", "```"), "<!--", "-->")
    rows = files.select("path", F.posexplode(F.split(blank, "\n")).alias("line", "body")).withColumn("body", F.regexp_replace("body", "`[^`]*`", ""))
    return rows.select("path", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("body", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)"), 1)).alias("target"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(path, nth, old_start, old_len, new_start, new_len) of unified hunk headers; a missing length is 1."""
    head = r"@@ -(\d+(?:,\d+)? \+\d+(?:,\d+)?) @@"
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract("name", p, 1), F.lit("")).cast("int"), F.lit(1))
    rows = _found(diffs, head)
    return rows.select("path", "nth", n(r"^(\d+)").alias("old_start"), n(r"^\d+,(\d+)").alias("old_len"), n(r"\+(\d+)").alias("new_start"), n(r"\+\d+,(\d+)").alias("new_len"))


def python_imports(files: DataFrame) -> DataFrame:
    """(path, name, line) of modules that lines of a Python file import."""
    rows = files.filter(F.col("path").endswith(".py")).select("path", F.posexplode(F.split(F.regexp_replace("text", "^\\uFEFF", ""), "\n")).alias("line", "body"))
    name = F.regexp_extract("body", r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", 0)
    return rows.withColumn("name", F.regexp_extract(name, r"(?:from|import)\s+([\w.]+)", 1)).filter("name <> ''").select("path", "name", (F.col("line") + 1).alias("line"))


def declared_tests(files: DataFrame) -> DataFrame:
    """(path, nth, name) of the tests a file declares in Python, JavaScript or Go."""
    pattern = r"(?m)(?:^\s*(?:async )?def (?=test)|^func (?=Test)|\b(?:it|test)\(\s*['\"`])([^'\"`(\n]+)"
    return _found(files, pattern)


def ci_steps(files: DataFrame) -> DataFrame:
    """(path, line, identity, body) of workflow lines that run something; the identity is the key and the first word run."""
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    key, word = F.regexp_extract("body", r"^\s*-?\s*(run|uses|script):", 1), F.regexp_extract("body", r":\s*['\"|>-]*\s*(\S+)", 1)
    return rows.filter(key != "").select("path", (F.col("line") + 1).alias("line"), F.concat_ws(" ", key, word).alias("identity"), "body")
