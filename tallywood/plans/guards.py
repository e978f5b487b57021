"""Queries on two states of the files written from part, and on texts and names written from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, extract, guard, python_source
from ..sources import files
from .registry import query, spread, table
from .trees import PATH, SILENCED, TEXT, made_files

#: What became of the text of the file of key k.
LATER = f"""CASE WHEN k % 40 = 4 THEN replace(text, 'def test_two', 'def check_two') WHEN k % 40 = 14 THEN replace(text, '    assertEqual(1, 1)', '    print(1)')
  WHEN k % 40 = 24 THEN replace(text, 'def test_two', 'def test_second') WHEN k % 40 = 5 THEN replace(text, 'run: pytest', 'echo: pytest') WHEN k % 40 = 15 THEN replace(text, 'threshold = ', 'threshold = -')
  WHEN k % 40 = 25 THEN replace(text, 'min_coverage', 'other') WHEN k % 40 = 35 THEN 'x: 1' || chr(10) || text WHEN k % 40 = 0 THEN text || chr(10) || 'y = 1  # type: ignore' ELSE text END"""


def later_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, text) of the later state: some files edited, those of keys ending in 10 of each 40 gone, some new."""
    f = made_files(spark, sf_dir)
    kept = f.filter("k % 40 <> 10").select("k", "path", F.expr(LATER).alias("text"))
    new = f.filter("k % 40 = 9").select("k", F.concat(F.lit("data/new"), F.col("k").cast("string"), F.lit(".txt")).alias("path"), F.lit("new").alias("text"))
    return kept.unionByName(new)


_FOUND = """
p AS (SELECT p_partkey AS k FROM part),
found AS (
  SELECT 'suppression' AS kind, 'src/pkg' || k % 7 || '/mod' || k || '.py' AS path, 17 AS line, 'silence' AS what, NULL AS detail FROM p WHERE k % 40 = 0
  UNION ALL SELECT 'deleted', 'src/pkg' || k % 7 || '/mod' || k || '.py', NULL, 'src/pkg' || k % 7 || '/mod' || k || '.py', NULL FROM p WHERE k % 40 = 10
  UNION ALL SELECT 'test removed', 'tests/test_m' || k || '.py', 5, 'test_two', NULL FROM p WHERE k % 40 = 4
  UNION ALL SELECT 'fewer assertions', 'tests/test_m' || k || '.py', NULL, 'tests/test_m' || k || '.py', '5 -> 4' FROM p WHERE k % 40 = 14
  UNION ALL SELECT 'step removed', '.github/workflows/w' || k || '.yml', 5, 'run pytest', NULL FROM p WHERE k % 40 = 5
  UNION ALL SELECT 'floor lowered', '.github/workflows/w' || k || '.yml', 7, 'threshold', k::DOUBLE || ' -> ' || (-k)::DOUBLE FROM p WHERE k % 40 = 15
  UNION ALL SELECT 'floor removed', '.github/workflows/w' || k || '.yml', 2, 'min_coverage', NULL FROM p WHERE k % 40 = 25)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return guard.findings(made_files(spark, sf_dir), later_files(spark, sf_dir), SILENCED, T.test_in_graph(p), T.is_ci(p))


@query(f"WITH {_FOUND} SELECT * FROM found")
def guard_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the later state lost or silenced, kind by kind."""
    return _findings(spark, sf_dir)


@query(f"""WITH {_FOUND}, c(kind, ceiling) AS (VALUES ('suppression', '100000'), ('deleted', '0'), ('test removed', 'few'), ('fewer assertions', '0'), ('step removed', '-1'), ('floor lowered', '1.5'), ('floor removed', '0'), ('other', '0'))
SELECT c.kind, coalesce(n, 0) AS n, ceiling, CASE WHEN NOT regexp_full_match(ceiling, '[0-9]+') THEN 'ERROR' WHEN coalesce(n, 0) > try_cast(ceiling AS BIGINT) THEN 'FAIL' ELSE 'PASS' END AS state
FROM c LEFT JOIN (SELECT kind, count(*) AS n FROM found GROUP BY kind) USING (kind)""")
def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each kind: within its ceiling, above it, or a ceiling that can't be read."""
    rows = [("suppression", "100000"), ("deleted", "0"), ("test removed", "few"), ("fewer assertions", "0"), ("step removed", "-1"), ("floor lowered", "1.5"), ("floor removed", "0"), ("other", "0")]
    return guard.report(_findings(spark, sf_dir), spark.createDataFrame(rows, "kind string, ceiling string"), F.col("ceiling").rlike("^[0-9]+$"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), f AS (
  SELECT k, CASE k % 10 WHEN 4 THEN 'tests/test_m' || k || '.py' WHEN 5 THEN '.github/workflows/w' || k || '.yml' ELSE 'src/pkg' || k % 7 || '/mod' || k || '.py' END AS path FROM p WHERE k % 10 IN (0, 4, 5))
SELECT path, CASE WHEN k % 40 = 10 THEN 'deleted' ELSE 'modified' END AS status FROM f WHERE k % 40 IN (0, 4, 5, 10, 14, 15, 24, 25, 35)
UNION ALL SELECT 'data/new' || k || '.txt', 'added' FROM p WHERE k % 40 = 9""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, modified and deleted between two states."""
    return files.changes(made_files(spark, sf_dir).select("path", "text"), later_files(spark, sf_dir).select("path", "text")).select("path", "status")


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'src/pkg' || k % 7 || '/mod' || k || '.py' AS path, CASE WHEN k % 40 = 10 THEN 'deleted' ELSE 'changed' END AS told FROM p WHERE k % 40 IN (0, 10)
UNION ALL SELECT 'tests/test_m' || k || '.py', 'changed' FROM p WHERE k % 40 IN (4, 14, 24)
UNION ALL SELECT '.github/workflows/w' || k || '.yml', 'outside' FROM p WHERE k % 40 IN (5, 15, 25, 35)
UNION ALL SELECT 'data/new' || k || '.txt', 'outside' FROM p WHERE k % 40 = 9""")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed names told apart: nodes of the graph of files, former ones, and others."""
    base, now = made_files(spark, sf_dir).select("path", "text"), later_files(spark, sf_dir).select("path", "text")
    node = F.col("path").rlike(r"\.(?:py|js|jsx|ts|tsx|mjs|cjs|md|html)$")
    return guard.since(files.changes(base, now), now.filter(node), base.filter(node))


@query("""SELECT l_suppkey AS path, count(*) AS n_hunks, sum(l_linenumber)::BIGINT AS old_start, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE l_quantity::BIGINT END)::BIGINT AS old_len, sum(l_linenumber + 2)::BIGINT AS new_start, sum(l_linenumber * 2)::BIGINT AS new_len FROM lineitem GROUP BY 1""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunk headers of a unified diff for every line item, added up for each supplier."""
    n = lambda c: c.cast("string")
    li = table(spark, sf_dir, "lineitem")
    old = F.concat(n(F.col("l_linenumber")), F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit(","), n(F.col("l_quantity").cast("long")))))
    head = F.concat(F.lit("--- a\n+++ b\n@@ -"), old, F.lit(" +"), n(F.col("l_linenumber") + 2), F.lit(","), n(F.col("l_linenumber") * 2), F.lit(" @@ def f():\n x"))
    hunks = extract.diff_hunks(li.select(F.col("l_suppkey").alias("path"), head.alias("text")))
    return hunks.groupBy("path").agg(F.count(F.lit(1)).alias("n_hunks"), *[F.sum(c).alias(c) for c in ("old_start", "old_len", "new_start", "new_len")])


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(text, '') AS whole FROM documents)
SELECT doc_id, CASE WHEN whole = '' THEN 0 ELSE len(string_split(whole, chr(10))) - CASE WHEN right(whole, 1) = chr(10) THEN 1 ELSE 0 END END AS n_lines,
  len(string_split(left(t, 100), chr(10))) AS line_of_100, CASE WHEN length(trim(t, ' ')) > 160 THEN left(trim(t, ' '), 160) || '...' ELSE trim(t, ' ') END AS excerpt,
  contains(t, chr(0)) AS is_binary, greatest(1, doc_id - 30) AS lo, doc_id + 30 AS hi FROM d""")
def document_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, the line of an offset, an excerpt and a region for every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    lo, hi = T.region(F.col("doc_id"), F.col("doc_id"), F.lit(False))
    return d.select("doc_id", T.line_count(F.col("t")).alias("n_lines"), T.line_of(F.col("t"), F.lit(100)).alias("line_of_100"), T.excerpt(F.col("t")).alias("excerpt"), T.is_binary(F.encode("t", "UTF-8")).alias("is_binary"), lo.alias("lo"), hi.alias("hi"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/b' || o_custkey || '/c' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'x/y' || o_custkey END AS path,
  CASE o_orderkey % 4 WHEN 0 THEN ['order', 'state', 'max'] WHEN 1 THEN ['http', 'server', 'id'] WHEN 2 THEN ['least'] ELSE ['a', 'b', (o_custkey % 10)::VARCHAR] END AS words,
  strftime(o_orderdate, '%Y-%m-%d') > '1995-06-15' AS later,
  CASE o_orderkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'dev' END AS face FROM orders""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made normal, identifiers in words, days compared and faces, for every order."""
    o, m = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    c = F.col("o_custkey").cast("string")
    path = F.when(m == 0, F.concat(F.lit("a/./b"), c, F.lit("//c/"))).when(m == 1, F.concat(F.lit("/abs/"), c)).when(m == 2, F.concat(F.lit("a/../"), c)).otherwise(F.concat(F.lit("x/y"), c))
    name = F.when(m == 0, "cfg.orderState_max").when(m == 1, "HTTPServer-id").when(m == 2, "x.y.least").otherwise(F.concat(F.lit("aB"), (F.col("o_custkey") % 10).cast("string")))
    note = F.when(m == 0, "User - seen by all").when(m == 1, "dev: tools").when(m == 2, "someone").otherwise("")
    return o.select("o_orderkey", T.normal_path(path).alias("path"), T.segments(name).alias("words"), T.later_day(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1995-06-15T00:00")).alias("later"), T.face(note).alias("face"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part), n AS (SELECT max(p_partkey) AS m FROM part WHERE p_partkey % 10 = 0)
SELECT count(*) AS n_files, count(*) FILTER (k % 10 IN (0, 4)) AS n_python, (SELECT sum(CASE WHEN k + 10 <= m THEN 3 ELSE 0 END + CASE WHEN k + 20 <= m THEN 1 ELSE 0 END) FROM p, n WHERE k % 10 = 0)::BIGINT AS n_edges,
  (SELECT sum(CASE WHEN k + 20 <= m THEN 1 ELSE 0 END) FROM p, n WHERE k % 10 = 0)::BIGINT AS n_inferred FROM p""")
def file_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the graph of files."""
    f = made_files(spark, sf_dir)
    a = f.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(T.language(F.col("path")) == "python").alias("n_python"))
    b = python_source.linked(f)["edges"].select("src", "dst", "kind", "inferred").distinct().agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("inferred").alias("n_inferred"))
    return a.join(b)  # one row each


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT path FROM (
  SELECT 'web/lib' || k || '.ts' AS path FROM p WHERE k % 10 = 2 UNION ALL SELECT 'vendor/x' || k || '.min.js' FROM p WHERE k % 10 = 8
  UNION ALL SELECT 'tests/test_m' || k || '.py' FROM p WHERE k % 10 = 4)""")
def unparsed_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files that no extractor of routes took anything from and that nobody accepted."""
    f = made_files(spark, sf_dir)
    claimed = python_source.routes(f).select("path").unionByName(extract.express_routes(f.filter(F.col("path").rlike(code.SCRIPT))).select("path")).unionByName(extract.page_routes(f).select("path")).distinct()
    accepted = f.filter("k % 10 = 6").select("path")
    surface = f.filter(F.col("path").rlike(code.SCRIPT) | F.col("path").rlike(r"\.py$") | F.col("path").rlike(r"package\.json$"))
    return surface.select("path").join(claimed, "path", "left_anti").join(accepted, "path", "left_anti")


@query("""SELECT a.p_partkey AS part, b.p_partkey AS copy FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey""")
def folder_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same brand, type and size at another place."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return spread(p, "p_partkey").select(F.col("p_partkey").alias("part"), "p_brand", "p_type", "p_size").join(p.withColumnRenamed("p_partkey", "copy"), ["p_brand", "p_type", "p_size"]).filter("part <> copy").select("part", "copy")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value FROM events)
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'grade' WHEN value IS NULL OR value < 5 THEN 'reason' ELSE 'example' END AS refused FROM e
WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') OR value IS NULL OR value < 5 OR (event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer))""")
def listing_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a listing refuses: an unknown grade, no reason, or an example that doesn't exist."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("there"))
    grade, reason = ~F.col("event_type").isin("click", "view", "purchase", "signup"), F.coalesce(F.col("value") < 5, F.lit(True))
    lost = (F.col("event_type") == "purchase") & F.col("there").isNull()
    return e.join(known, "user_id", "left").select("event_id", F.when(grade, "grade").when(reason, "reason").when(lost, "example").alias("refused")).filter("refused IS NOT NULL")


@query("""SELECT o_custkey, o_orderkey AS first_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1""")
def first_of_each_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry, the first, for each customer and status."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderstatus").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("first_order"))
