"""Queries on descriptions, pointers, blocks and deployments written from the rows of part, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import notes
from .registry import query, table


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """k, the key of a part, and columns of text, in which {…} stands for an expression of k."""
    import re

    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    quoted = lambda v: "'" + re.sub(r"\{([^}]*)\}", r"' || cast(\1 as string) || '", v.replace("'", "\\'")) + "'"
    return k.select("k", *[F.expr(quoted(v)).alias(n) for n, v in columns.items()])


@query("""SELECT p_partkey AS k, list_sort(list_distinct(['check part ' || p_partkey, '/part-' || p_partkey % 7, 'run part' || p_partkey, 'a size ' || p_partkey % 50])) AS phrases FROM part""")
def named_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What descriptions say they are called by."""
    d = _parts(spark, sf_dir, d='Use when someone says run part{k}, "Check part {k}" or /part-{k % 7}; asks for a  size {k % 50} and more. Not a/b nor "x".')
    return d.select("k", notes.phrases(F.col("d")).alias("phrases"))


@query("""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'load-data-' || p_partkey % 3 WHEN 1 THEN 'load-data' WHEN 2 THEN 'the-skill-' || p_partkey % 5 ELSE 'data' END AS a, CASE p_size % 3 WHEN 0 THEN 'load-data' WHEN 1 THEN 'my-data-load' ELSE 'the-skill-9' END AS b, p_size % 2 = 0 AS said, (p_partkey % 10) / 100.0 AS j FROM part)
SELECT k, a = b OR (length(a) > 5 AND contains(b, a)) OR (length(b) > 5 AND contains(a, b)) OR (len(list_filter(list_intersect(string_split(a, '-'), string_split(b, '-')), lambda x: x NOT IN ('and', 'skill', 'skills', 'the'))) >= 2 AND (j >= 0.05 OR said)) AS hit FROM n""")
def name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are of one kind (M4)."""
    p, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    a = F.when(m == 0, F.concat(F.lit("load-data-"), (F.col("p_partkey") % 3).cast("string"))).when(m == 1, "load-data").when(m == 2, F.concat(F.lit("the-skill-"), (F.col("p_partkey") % 5).cast("string"))).otherwise("data")
    b = F.when(F.col("p_size") % 3 == 0, "load-data").when(F.col("p_size") % 3 == 1, "my-data-load").otherwise("the-skill-9")
    return p.select(F.col("p_partkey").alias("k"), notes.name_hit(a, b, (F.col("p_partkey") % 10) / 100, F.col("p_size") % 2 == 0).alias("hit"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), r AS (
  SELECT k, 'src/mod' || (k + k % 2) || '.py' AS path, 10 AS first, 10 + k % 9 AS last, CASE WHEN k % 3 = 0 THEN 'abcdef' || (1000 + k) END AS stamp, (k + k % 2) IN (SELECT k FROM p WHERE k % 2 = 0) AS there FROM p
  UNION ALL SELECT k, 'lost' || k || '.md', 5, 5, NULL, false FROM p UNION ALL SELECT k, 'run.test', 80, 80, NULL, true FROM p)
SELECT k, path, first::BIGINT AS first, last::BIGINT AS last, stamp, there, coalesce(stamp, CASE WHEN k % 5 = 0 THEN 'blame' || k END, 'today') AS base FROM r""")
def line_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers to lines told from hosts with ports, and what they are held against: stamp, blame or today."""
    t = _parts(spark, sf_dir, a="See src/mod{k + k % 2}.py:10-{10 + k % 9}", s=" @abcdef{1000 + k}", z=" or app.example.com:8443, 127.0.0.1:80, localhost:3000, lost{k}.md:5, lost{k}.md:5 and run.test:80")
    t = t.select("k", F.concat("a", F.when(F.col("k") % 3 == 0, F.col("s")).otherwise(""), "z").alias("text"))
    files = t.filter("k % 2 = 0").select(F.concat(F.lit("src/mod"), F.col("k").cast("string"), F.lit(".py")).alias("path")).unionAll(spark.createDataFrame([("run.test",)], "path string"))
    blame = F.when(F.col("k") % 5 == 0, F.concat(F.lit("blame"), F.col("k").cast("string")))
    return notes.pointers(t, files, id="k").withColumn("base", F.coalesce("stamp", blame, F.lit("today")))


_LINES = """lines AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line, l_quantity::BIGINT AS q FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """(file, line, text): line items as the lines of their supplier's file."""
    numbered = F.expr("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), numbered.alias("line"), F.col("l_quantity").cast("long").alias("q")).select("file", "line", text.alias("text"))


@query(f"""WITH {_LINES}, n AS (SELECT file, line, min(CASE WHEN q % 5 <> 1 THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM lines)
SELECT n.file, count(*) FILTER (x.q % 5 IN (0, 2)) AS n_opens, coalesce(sum(n.line) FILTER (x.q % 5 IN (0, 2)), 0)::BIGINT AS places FROM n LEFT JOIN lines x ON x.file = n.file AND x.line = n.next GROUP BY 1""")
def block_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before a fenced block, counted for each file."""
    m = F.col("q") % 5
    lines = _lines(spark, sf_dir, F.when(m == 0, "```sh").when(m == 1, "  ").when(m == 2, "  ~~~").otherwise("words ```"))
    found = notes.opens_block(lines, "file", "line", "text")
    return found.groupBy("file").agg(F.count_if("opens").alias("n_opens"), F.coalesce(F.sum(F.when(F.col("opens"), F.col("line"))), F.lit(0)).cast("long").alias("places"))


@query(f"""WITH {_LINES}, e AS (SELECT file, max(line) AS n FROM lines GROUP BY 1), m AS (SELECT file, line, CASE q WHEN 7 THEN 'b' WHEN 8 THEN 'b' WHEN 9 THEN 'e' END AS mark FROM lines WHERE q IN (7, 8, 9)),
whole AS (SELECT DISTINCT file FROM lines WHERE q = 10 AND line <= 10),
b AS (SELECT file, line, (SELECT max(line) FROM m y WHERE y.file = m.file AND y.line < m.line AND y.mark = 'e') AS closed, (SELECT max(line) FROM m y WHERE y.file = m.file AND y.line < m.line AND y.mark = 'b') AS begun,
  (SELECT min(line) FROM m y WHERE y.file = m.file AND y.line > m.line AND y.mark = 'e') AS stop FROM m WHERE mark = 'b')
SELECT file, line AS first, coalesce(stop, n) AS last FROM b JOIN e USING (file) WHERE (begun IS NULL OR closed > begun) AND file NOT IN (SELECT file FROM whole)
UNION ALL SELECT file, 1, n FROM whole JOIN e USING (file)""")
def set_apart_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a pragma sets apart."""
    q = F.col("q")
    lines = _lines(spark, sf_dir, F.when(q.isin(7, 8), " # check: fixture-begin").when(q == 9, "// check: fixture-end").when(q == 10, "# check: fixture").otherwise("x = 1  # check: fixture-begin here"))
    return notes.fixture_spans(lines, "file", "line", "text", r"^\s*(?:#|//|--)\s*check: fixture(-begin|-end)?\s*$")


@query(f"""WITH {_LINES}, e AS (SELECT file, line, CASE WHEN q % 2 = 0 THEN 'testpaths' ELSE 'include' END AS key, unnest(['a' || q % 5, 'b/c' || q % 3]) AS e FROM lines WHERE q % 4 < 3)
SELECT file, key, min(line) AS line, list_sort(list_distinct(list(e))) AS entries FROM e GROUP BY file, key""")
def collected_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that settings list, for each file and key."""
    q = F.col("q")
    body = F.concat(F.lit('["a'), (q % 5).cast("string"), F.lit("\", 'b/c"), (q % 3).cast("string"), F.lit("']"))
    lines = _lines(spark, sf_dir, F.when(q % 4 == 3, "omit = [x]").when(q % 2 == 0, F.concat(F.lit("  testpaths = "), body)).otherwise(F.concat(F.lit('"include": '), body)))
    return notes.collected_paths(lines, "file", "line", "text", ["testpaths", "include"])


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'srv' || k || '/Procfile' AS path, u.line, 'process' AS kind, u.name, u.what FROM (SELECT k, unnest([{line: 1, name: 'web', what: 'serve' || k}, {line: 4, name: 'work-er', what: 'run'}]) AS u FROM p WHERE k % 4 = 0)
UNION ALL SELECT 'srv' || k || '/Dockerfile', 1, 'image', 'dockerfile', CASE WHEN k % 8 = 1 THEN '80' || k % 90 || ', 90 91' ELSE '' END FROM p WHERE k % 4 = 1
UNION ALL SELECT '.github/workflows/w' || k || '.yml', 1, 'workflow', CASE WHEN k % 8 = 2 THEN 'Build ' || k ELSE 'w' || k END, CASE WHEN k % 8 = 2 THEN 'push' ELSE '' END FROM p WHERE k % 4 = 2""")
def deployed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes, images and workflows of every project (X11)."""
    f = _parts(spark, sf_dir, proc="web: serve{k} --port 1\\n# none: x\\n bad: y\\nwork-er : run", image="FROM x\\nEXPOSE 80{k % 90} # one\\n  expose 90 91", plain="FROM x", flow="name: \"Build {k}\"\\non: push\\njobs:", bare="on:\\n  push:", at="srv{k}/", wf=".github/workflows/w{k}.yml")
    m, e = F.col("k") % 4, F.col("k") % 8
    path = F.when(m == 0, F.concat("at", F.lit("Procfile"))).when(m == 1, F.concat("at", F.lit("Dockerfile"))).when(m == 2, F.col("wf")).otherwise(F.concat("at", F.lit("notes.txt")))
    text = F.when(m == 0, F.col("proc")).when(e == 1, F.col("image")).when(m == 1, F.col("plain")).when(e == 2, F.col("flow")).when(m == 2, F.col("bare")).otherwise("web: x")
    return notes.deployments(f.select(path.alias("path"), text.alias("text")))


@query("""WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < '1996-01-01'), f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= '1995-01-01')
SELECT *, 'stored' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'fresh' FROM (SELECT * FROM f EXCEPT SELECT * FROM s)""")
def block_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a stored and a fresh block don't share."""
    o = table(spark, sf_dir, "orders")
    return notes.line_difference(o.filter("o_orderdate < '1996-01-01'"), o.filter("o_orderdate >= '1995-01-01'"), ["o_custkey", "o_orderpriority"])


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS file, 'site/api' || k || '/x.py' AS path FROM p WHERE k % 5 <> 4 AND k % 2 = 0""")
def paths_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that code names by joined parts."""
    f = _parts(spark, sf_dir, a="open(os.path.join(BASE, \"api{k}\", \"x.py\"))", b="p = ROOT / \"api{k}\" / \"x.py\"", c="p = ROOT.joinpath(\"site\", \"api{k}/\", \"x.py\")", d="q = os.path.join(\"site\", \"api{k}\", \"x.py\")", e="r = os.path.join(\"x.py\")", at="site/api{k}/x.py")
    m = F.col("k") % 5
    text = F.when(m == 0, F.col("a")).when(m == 1, F.col("b")).when(m == 2, F.col("c")).when(m == 3, F.col("d")).otherwise(F.col("e"))
    return notes.joined_paths(f.select(F.col("k").alias("file"), text.alias("text")), f.filter("k % 2 = 0").select(F.col("at").alias("path")))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem)
SELECT l_suppkey, nth, l_orderkey, l_linenumber, n > 400 AS truncated FROM r JOIN c USING (l_suppkey) WHERE nth <= 400""")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 400 places of each supplier, and whether there are more."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return notes.capped(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_partkey")


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'tests/test_a' ELSE 'src/b' END || p_size || '.py' AS file, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS apart FROM part""")
def hits_in_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in tests are set apart unless the text names the test."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "tests/test_a").otherwise("src/b"), F.col("p_size").cast("string"), F.lit(".py")).alias("file"))
    named = F.concat(F.lit("It is checked by `"), F.substring_index("file", "/", -1), F.lit("`. Or x.py, e.g. here."))
    texts = p.select("k", F.when(F.col("k") % 3 == 0, named).otherwise("See test_a.py.").alias("text"))
    return notes.hits_apart(p, texts, T.test_in_graph(F.col("file")), "k", "file", "text")
