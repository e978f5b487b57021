"""Queries on source files. The files are written from the rows of part, one each, so that the SQL knows what stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, extract, python_source
from .registry import query, table

_N = "' || cast({} as string) || '"


def _text(*parts: str) -> str:
    """An expression, alike in Spark SQL and DuckDB, of lines with numbers: {k}, {k + 10} and the like are computed."""
    import re

    return "('" + "' || chr(10) || '".join(re.sub(r"\{([^}]*)\}", lambda m: _N.format(m[1]), p.replace("'", "''")) for p in parts) + "')"


PYTHON = _text(
    "import os", "from pkg{(k + 10) % 7}.mod{k + 10} import run{k + 10}, Base{k + 10}", "class Kind{k}(Base{k + 10}):", "    def go(self):",
    '        return os.environ.get("APP_KEY_{k % 13}")', "def run{k}():", "    run{k + 10}()", "    helper{k + 20}()", "class Base{k}:", "    pass",
    "def helper{k}():", "    return {k % 50}  # noqa: E{k % 9}", '@app.route("/api/v1/items{k}", methods=["POST"])', "def handle{k}():", "    return run{k}()",
    'parser.add_argument("--size-{k}", "-s")',
)
SCRIPTS = _text("// import x from './no'", "import {k}a from './lib{k + 1}';", "const z = require('../data/cfg{k + 8}.json');", "export * from './app{k + 10}.js';", "const lazy = import('./lazy{k}.js');", "app.get('/shop/:id{k}', f); const e = process.env.JS_KEY_{k % 11};").replace(" || 'a from", " || ' from")
MARKDOWN = _text("---", "name: guide-{k}", 'title: "Guide number {k}"', "tags:", "---", "# Guide {k}", "See [next](d{k + 10}.md) and ![image](i{k}.png) and `[no](x.md)`.", "```", "[not this](fenced{k}.md)", "```", "[ref]: ../web/app{k - 2}.js", "Also [[Guide {k % 7}]] here.")
TESTS = _text("def test_one_{k}():", "    assert {k} == {k}", "    assertEqual(1, 1)", "", "def test_two():", "    # assert nothing", "    x = expect({k % 5})", "class Other:", "    def test_three(self):", "        pass", "@pytest.mark.skip", "def test_four_{k % 3}():", "    assert True; assert {k}")
STEPS = _text("name: w{k}", "min_coverage: {k % 90}", "steps:", "  - uses: tool/checkout@v{k % 4}", "  - run: pytest -q part{k}", "  - run: ruff check || true", "  threshold = {k}")
#: How each row of part becomes a file: the last digit of its key chooses.
PATH = """CASE k % 10 WHEN 0 THEN 'src/pkg' || cast(k % 7 as string) || '/mod' || cast(k as string) || '.py' WHEN 1 THEN 'web/app' || cast(k as string) || '.js'
  WHEN 2 THEN 'web/lib' || cast(k as string) || '.ts' WHEN 3 THEN 'docs/d' || cast(k as string) || '.md' WHEN 4 THEN 'tests/test_m' || cast(k as string) || '.py'
  WHEN 5 THEN '.github/workflows/w' || cast(k as string) || '.yml' WHEN 6 THEN 'app' || cast(k as string) || '/package.json'
  WHEN 7 THEN 'src/app/shop' || cast(k as string) || '/page.tsx' WHEN 8 THEN 'vendor/x' || cast(k as string) || '.min.js' ELSE 'data/cfg' || cast(k as string) || '.json' END"""
TEXT = f"""CASE k % 10 WHEN 0 THEN {PYTHON} WHEN 1 THEN {SCRIPTS} WHEN 2 THEN 'export const v = ' || cast(k as string) || ';' || chr(10) WHEN 3 THEN {MARKDOWN} WHEN 4 THEN {TESTS}
  WHEN 5 THEN {STEPS} WHEN 6 THEN '{{"scripts": {{"build": "make ' || cast(k as string) || '", "test": "run"}}}}' WHEN 7 THEN '' WHEN 8 THEN repeat('x', 2500) ELSE '{{}}' END"""
FILES = f"SELECT k, {PATH} AS path, {TEXT} AS text FROM (SELECT p_partkey AS k FROM part)"


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, text): a file for every row of part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select("k", F.expr(PATH).alias("path"), F.expr(TEXT).alias("text"))


def _path(k: str, kind: int) -> str:
    """The path, as SQL, of the file of key k of a kind."""
    return {0: f"'src/pkg' || ({k}) % 7 || '/mod' || ({k}) || '.py'", 1: f"'web/app' || ({k}) || '.js'", 2: f"'web/lib' || ({k}) || '.ts'", 3: f"'docs/d' || ({k}) || '.md'", 4: f"'tests/test_m' || ({k}) || '.py'", 5: f"'.github/workflows/w' || ({k}) || '.yml'", 9: f"'data/cfg' || ({k}) || '.json'"}[kind]


@query(f"""
WITH f AS ({FILES})
SELECT path, CASE k % 10 WHEN 0 THEN 'python' WHEN 4 THEN 'python' WHEN 1 THEN 'javascript' WHEN 8 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 7 THEN 'typescript' WHEN 3 THEN 'markdown' WHEN 6 THEN 'json' WHEN 9 THEN 'json' END AS language,
  CASE WHEN k % 10 IN (0, 1, 2, 4, 7, 8) THEN 'code' WHEN k % 10 = 3 THEN 'prose' ELSE 'data' END AS kind,
  CASE k % 10 WHEN 0 THEN 16 WHEN 1 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 13 WHEN 5 THEN 7 WHEN 7 THEN 0 ELSE 1 END AS n_lines,
  k % 10 = 4 AS in_tests, k % 10 = 5 AS is_ci, CASE WHEN k % 10 = 8 THEN 'name' END AS generated, k % 10 IN (0, 4) AS in_python_scope,
  CASE WHEN k % 10 = 7 THEN 0 ELSE length(split_part(text, chr(10), 1)) END AS first_length FROM f""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's language, kind, lines, and what its name says."""
    f = made_files(spark, sf_dir)
    p, t = F.col("path"), F.col("text")
    return f.select("path", T.language(p).alias("language"), T.kind(p, t).alias("kind"), T.line_count(t).alias("n_lines"), T.test_in_graph(p).alias("in_tests"), T.is_ci(p).alias("is_ci"), T.generated(p, t).alias("generated"), T.in_scope(p, "*.py").alias("in_python_scope"), F.length(F.substring_index(t, "\n", 1)).alias("first_length"))


@query("""
WITH p AS (SELECT p_partkey AS k FROM part), py AS (SELECT k, 'src/pkg' || k % 7 || '/mod' || k || '.py' AS path FROM p WHERE k % 10 = 0), t AS (SELECT k, 'tests/test_m' || k || '.py' AS path FROM p WHERE k % 10 = 4)
SELECT path, u.line, u.kind, u.name FROM (
  SELECT path, unnest([{line: 3, kind: 'class', name: 'Kind' || k}, {line: 6, kind: 'function', name: 'run' || k}, {line: 9, kind: 'class', name: 'Base' || k}, {line: 11, kind: 'function', name: 'helper' || k}, {line: 14, kind: 'function', name: 'handle' || k}]) AS u FROM py
  UNION ALL SELECT path, unnest([{line: 1, kind: 'function', name: 'test_one_' || k}, {line: 5, kind: 'function', name: 'test_two'}, {line: 8, kind: 'class', name: 'Other'}, {line: 12, kind: 'function', name: 'test_four_' || k % 3}]) FROM t)""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and functions of every Python file."""
    return python_source.linked(made_files(spark, sf_dir))["symbols"].select("path", "line", F.when(F.col("what") == "def", "function").otherwise("class").alias("kind"), "name")


@query(f"""
WITH p AS (SELECT p_partkey AS k, max(p_partkey) OVER () AS m FROM part WHERE p_partkey % 10 = 0)
SELECT {_path("k", 0)} AS src, {_path("k + 10", 0)} AS dst, u.kind, false AS inferred FROM (SELECT *, unnest([{{kind: 'import'}}, {{kind: 'calls'}}, {{kind: 'inherits'}}]) AS u FROM p) WHERE k + 10 <= m
UNION ALL SELECT {_path("k", 0)}, {_path("k + 20", 0)}, 'calls', true FROM p WHERE k + 20 <= m""")
def python_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, calls and inheritance resolved to files."""
    return python_source.linked(made_files(spark, sf_dir))["edges"].select("src", "dst", "kind", "inferred").distinct()


@query("""SELECT 'os' AS name, count(*) AS n_files FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'pkg' || (m + 10) % 7, 1 FROM (SELECT max(p_partkey) AS m FROM part WHERE p_partkey % 10 = 0)""")
def external_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that no file answers to, by the number of files that import them."""
    return python_source.linked(made_files(spark, sf_dir))["externals"].select("name", "n_files")


@query(f"""
WITH p AS (SELECT p_partkey AS k, (SELECT max(p_partkey) FROM part) AS m FROM part WHERE p_partkey % 10 = 1)
SELECT {_path("k", 1)} AS src, CASE WHEN k + 1 <= m THEN {_path("k + 1", 2)} END AS dst, 'import' AS kind, 2 AS line FROM p
UNION ALL SELECT {_path("k", 1)}, CASE WHEN k + 8 <= m THEN {_path("k + 8", 9)} END, 'require', 3 FROM p
UNION ALL SELECT {_path("k", 1)}, CASE WHEN k + 10 <= m THEN {_path("k + 10", 1)} END, 'reexport', 4 FROM p
UNION ALL SELECT {_path("k", 1)}, NULL, 'dynamic-import', 5 FROM p""")
def script_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of JavaScript files resolved to files, unresolved ones without."""
    return code.script_edges(made_files(spark, sf_dir))


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'src/pkg' || k % 7 || '/mod' || k || '.py' AS path, 'POST' AS method, '/api/v1/items' || k AS route, 'handle' || k AS handler FROM p WHERE k % 10 = 0
UNION ALL SELECT 'web/app' || k || '.js', 'GET', '/shop/:id' || k, NULL FROM p WHERE k % 10 = 1
UNION ALL SELECT 'src/app/shop' || k || '/page.tsx', 'GET', '/shop' || k, NULL FROM p WHERE k % 10 = 7""")
def web_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of decorators, of calls and of page files."""
    f = made_files(spark, sf_dir)
    none = F.lit(None).cast("string").alias("handler")
    a = python_source.routes(f).select("path", "method", "route", "handler")
    b = extract.express_routes(f.filter(F.col("path").rlike(code.SCRIPT))).select("path", "method", "route", none)
    return a.unionByName(b).unionByName(extract.page_routes(f).select("path", F.lit("GET").alias("method"), "route", none))


@query("""SELECT 'app' || p_partkey || '/package.json' AS path, u.name, CASE WHEN u.name = 'test' THEN 'run' ELSE 'make ' || p_partkey END AS command
FROM (SELECT p_partkey, unnest([{name: 'build'}, {name: 'test'}]) AS u FROM part WHERE p_partkey % 10 = 6)""")
def package_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of package files."""
    return extract.package_scripts(made_files(spark, sf_dir))


@query("""SELECT 'src/pkg' || p_partkey % 7 || '/mod' || p_partkey || '.py' AS path, 'APP_KEY_' || p_partkey % 13 AS name FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'web/app' || p_partkey || '.js', 'JS_KEY_' || p_partkey % 11 FROM part WHERE p_partkey % 10 = 1""")
def environment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment variables that files other than tests read."""
    f = made_files(spark, sf_dir)
    return extract.environment_names(f.filter(~T.test_in_graph(F.col("path"))))


@query("""SELECT 'docs/d' || k || '.md' AS path, u.line, u.kind, u.target FROM (SELECT p_partkey AS k, unnest([{line: 7, kind: 'link', target: 'd' || (p_partkey + 10) || '.md'},
  {line: 11, kind: 'reference', target: '../web/app' || (p_partkey - 2) || '.js'}, {line: 12, kind: 'wikilink', target: 'Guide ' || p_partkey % 7}]) AS u FROM part WHERE p_partkey % 10 = 3)""")
def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, reference definitions and wikilinks outside code."""
    return code.markdown_references(made_files(spark, sf_dir))


@query("""SELECT 'docs/d' || k || '.md' AS path, u.key, u.value, u.style FROM (SELECT p_partkey AS k, unnest([{key: 'name', value: 'guide-' || p_partkey, style: 'plain'},
  {key: 'title', value: 'Guide number ' || p_partkey, style: 'quoted'}, {key: 'tags', value: NULL, style: 'mapping'}]) AS u FROM part WHERE p_partkey % 10 = 3)""")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys before the text of Markdown files, with their style."""
    return code.frontmatter(made_files(spark, sf_dir))


@query("""SELECT 'tests/test_m' || k || '.py' AS path, u.line, u.name, u.body FROM (SELECT p_partkey AS k, unnest([
  {line: 1, name: 'test_one_' || p_partkey, body: '    assert ' || p_partkey || ' == ' || p_partkey || chr(10) || '    assertEqual(1, 1)' || chr(10)},
  {line: 5, name: 'test_two', body: '    # assert nothing' || chr(10) || '    x = expect(' || p_partkey % 5 || ')'},
  {line: 12, name: 'test_four_' || p_partkey % 3, body: '    assert True; assert ' || p_partkey}]) AS u FROM part WHERE p_partkey % 10 = 4)""")
def test_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that Python files declare, with line and body."""
    return code.test_bodies(made_files(spark, sf_dir))


@query("""SELECT 'tests/test_m' || p_partkey || '.py' AS path, 5 AS n FROM part WHERE p_partkey % 10 = 4""")
def assertion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of each file, comment lines skipped (A10)."""
    return code.assertions(made_files(spark, sf_dir))


@query("""SELECT '.github/workflows/w' || k || '.yml' AS path, u.line, u.identity FROM (SELECT p_partkey AS k, unnest([{line: 4, identity: 'uses tool/checkout@v' || p_partkey % 4},
  {line: 5, identity: 'run pytest'}, {line: 6, identity: 'run ruff'}]) AS u FROM part WHERE p_partkey % 10 = 5)""")
def ci_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of workflow files."""
    f = made_files(spark, sf_dir)
    return extract.ci_steps(f.filter(T.is_ci(F.col("path")))).select("path", "line", "identity")


@query("""SELECT '.github/workflows/w' || k || '.yml' AS path, u.line, u.key, u.floor FROM (SELECT p_partkey AS k, unnest([{line: 2, key: 'min_coverage', floor: (p_partkey % 90)::DOUBLE}, {line: 7, key: 'threshold', floor: p_partkey::DOUBLE}]) AS u FROM part WHERE p_partkey % 10 = 5)""")
def floor_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers set for keys that name a floor."""
    return code.floors(made_files(spark, sf_dir))


@query("""SELECT 'src/pkg' || p_partkey % 7 || '/mod' || p_partkey || '.py' AS path, 16 AS line, u.flag FROM (SELECT p_partkey, unnest([{flag: '--size-' || p_partkey}, {flag: '-s'}]) AS u FROM part WHERE p_partkey % 10 = 0)""")
def cli_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that Python files declare."""
    return python_source.flags(made_files(spark, sf_dir)).select("path", "line", "flag")


#: Ways to silence a check (rule, pattern).
SILENCED = (("silence", r"#\s*noqa\b|#\s*type:\s*ignore|eslint-disable|@ts-ignore"), ("skip", r"@pytest\.mark\.skip|\bit\.skip\(|\bxit\("), ("soften", r"\|\|\s*true\b|continue-on-error:\s*true"))


@query("""SELECT 'src/pkg' || p_partkey % 7 || '/mod' || p_partkey || '.py' AS path, 12 AS line, 'silence' AS rule FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'tests/test_m' || p_partkey || '.py', 11, 'skip' FROM part WHERE p_partkey % 10 = 4
UNION ALL SELECT '.github/workflows/w' || p_partkey || '.yml', 6, 'soften' FROM part WHERE p_partkey % 10 = 5""")
def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that silence, skip or soften a check."""
    return code.suppressions(made_files(spark, sf_dir), SILENCED)


@query("""
WITH p AS (SELECT p_partkey AS k FROM part), n AS (SELECT count(*) AS c FROM part WHERE p_partkey % 10 = 7)
SELECT 'web/app' || k || '.js' AS name, 'exact' AS how, 'web/app' || k || '.js' AS path, 1 AS candidates FROM p WHERE k % 10 = 1
UNION ALL SELECT 'mod' || k || '.py', 'suffix', 'src/pkg' || k % 7 || '/mod' || k || '.py', 1 FROM p WHERE k % 10 = 0
UNION ALL SELECT 'page.tsx', CASE WHEN c > 1 THEN 'ambiguous' WHEN c = 1 THEN 'suffix' ELSE 'unknown' END, CASE WHEN c = 1 THEN (SELECT min('src/app/shop' || k || '/page.tsx') FROM p WHERE k % 10 = 7) END, c FROM n
UNION ALL SELECT 'gone' || k || '.py', 'unknown', NULL, 0 FROM p WHERE k % 10 = 3""")
def located_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up as whole paths, then as their unique ends; others are refused."""
    f, k = made_files(spark, sf_dir), F.col("k")
    name = F.when(k % 10 == 1, F.col("path")).when(k % 10 == 0, F.concat(F.lit("mod"), k.cast("string"), F.lit(".py"))).when(k % 10 == 3, F.concat(F.lit("gone"), k.cast("string"), F.lit(".py")))
    asked = f.select(name.alias("name")).filter("name IS NOT NULL").unionByName(spark.createDataFrame([("page.tsx",)], "name string"))
    return code.located(asked, f.select("path"))
