"""Queries on graphs: nations and those that follow in orders, users and those of the next error."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, tours
from .registry import query, table


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's two most frequent next nations: suppliers of line n and n + 1 of an order."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(supplier, "l_suppkey")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("s_nationkey").alias("src"))
    pairs = a.join(line.select("l_orderkey", "l_linenumber", F.col("s_nationkey").alias("dst")), ["l_orderkey", "l_linenumber"]).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")  # 25 nations at most in each
    return pairs.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("src", "dst", F.when(F.col("r") == 1, "import").otherwise("calls").alias("kind"))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user to the user of the next error event."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("ts", "event_id", "user_id")
    ordered = graph.ranked(e, ["ts", "event_id"])
    after = ordered.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("dst"))
    return ordered.select("rank", F.col("user_id").alias("src")).join(after, "rank").filter("src <> dst").select("src", "dst", F.lit("import").alias("kind"))


NATIONS = """
l AS (SELECT l_orderkey, l_linenumber, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT a.n AS src, b.n AS dst, count(*) AS c FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.n <> b.n GROUP BY ALL),
e AS (SELECT src, dst, CASE WHEN r = 1 THEN 'import' ELSE 'calls' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM p) WHERE r <= 2)
"""
USERS = """
v AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error'),
e AS (SELECT src, dst, 'import' AS kind FROM v WHERE src <> dst)
"""
_DEGREES = """, d AS (SELECT node, count(DISTINCT i) AS in_degree, count(DISTINCT o) AS out_degree FROM (
  SELECT dst AS node, src AS i, NULL AS o FROM e UNION ALL SELECT src, NULL, dst FROM e) GROUP BY node)"""


@query(f"WITH {USERS} {_DEGREES} SELECT * FROM d")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(user_edges(spark, sf_dir))


@query(f"WITH {USERS} {_DEGREES} SELECT * FROM d WHERE in_degree > 0 ORDER BY in_degree DESC, out_degree DESC, node LIMIT 15")
def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(user_edges(spark, sf_dir))


@query(f"WITH {NATIONS} SELECT 'out' AS way, dst AS other, kind FROM e WHERE src = (SELECT min(src) FROM e) UNION ALL SELECT 'in', src, kind FROM e WHERE dst = (SELECT min(src) FROM e)")
def graph_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of and into the first nation."""
    e = graph.cut(nation_edges(spark, sf_dir))
    return graph.explained(e, _nodes(e), e.agg(F.min("src")).first()[0])


@query(f"WITH {USERS} {_DEGREES} SELECT * FROM d")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees from an exported graph that is read again."""
    path = f"{graph.shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    graph.exported(user_edges(spark, sf_dir), path)
    return graph.degrees(graph.imported(spark, path))


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst"))


@query(f"""WITH RECURSIVE {NATIONS}, w AS (
  SELECT (SELECT min(dst) FROM e) AS node, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node WHERE w.depth < 30)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""")
def graph_affected_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the first nation, and over how many edges."""
    e = graph.cut(nation_edges(spark, sf_dir))
    return graph.walk(e, [e.agg(F.min("dst")).first()[0]], reverse=True).select("node", "depth")


@query()
def graph_affected_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the neighbour by which each was reached first."""
    e = graph.cut(nation_edges(spark, sf_dir))
    return graph.walk(e, [e.agg(F.min("dst")).first()[0]], reverse=True)


@query()
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from the last nation to the first."""
    e = graph.cut(nation_edges(spark, sf_dir))
    a, b = e.agg(F.max("src"), F.min("dst")).first()
    return graph.path(e, _nodes(e), a, b)


@query(f"""WITH RECURSIVE {NATIONS}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b),
m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT node, component FROM m""")
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on cycles, by strongly connected component."""
    return graph.cycles(nation_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {USERS}, c AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b),
m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT node, component FROM m""")
def graph_cycles_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on cycles of next errors."""
    return graph.cycles(user_edges(spark, sf_dir))


@query()
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of users by next errors, of all error events."""
    return graph.clusters(user_edges(spark, sf_dir))


@query()
def graph_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.cut(nation_edges(spark, sf_dir))
    return graph.tour(e, [r.src for r in e.select("src").distinct().orderBy("src").limit(2).collect()])


@query("""
SELECT l_suppkey AS src, 1000000 + l_partkey AS dst, l_returnflag AS kind, list_sort(list(DISTINCT l_linestatus)) AS symbols, min(nullif(l_linenumber - 1, 0))::INT AS line, bool_and(l_discount > 0.02) AS inferred
FROM lineitem GROUP BY ALL""")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' deliveries as references, merged into edges."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("symbol"), (F.col("l_linenumber") - 1).alias("line"), (F.col("l_discount") > 0.02).alias("inferred"))
    return graph.merged_edges(refs)


@query(f"WITH {USERS}, x AS (SELECT DISTINCT src, dst, kind FROM e), b AS (SELECT src AS a, dst AS b FROM x UNION ALL SELECT dst, src FROM x) SELECT a, b, count(*) AS w FROM b GROUP BY ALL")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weights(user_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {USERS} {_DEGREES}, h AS (SELECT node FROM d WHERE in_degree > 0 ORDER BY in_degree DESC, out_degree DESC, node LIMIT 15),
r AS (SELECT h.node AS hub, e.src AS node FROM h JOIN e ON e.dst = h.node UNION SELECT r.hub, e.src FROM r JOIN e ON e.dst = r.node),
t AS (SELECT user_id AS node FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup'))
SELECT h.node, (SELECT count(*) FROM r WHERE r.hub = h.node AND r.node <> h.node AND r.node IN (SELECT node FROM t)) AS n_tests FROM h""")
def hub_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests that depend on each hub: users who signed up stand for tests."""
    e = graph.cut(user_edges(spark, sf_dir))
    tests = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("node"))
    return tours.test_dependents(e, graph.hubs(e).select("node"), tests)


@query()
def graph_tour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order in which to read users by next errors: user 0 is the front page, who buys more than views a program, who mostly
    views a page, and who signed up more than once a test (G11, T8)."""
    e = graph.cut(user_edges(spark, sf_dir))
    of = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count_if(F.col("event_type") == "purchase").alias("buys"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    nodes = of.select("node", (F.col("node") == 0).alias("first"), (F.col("buys") > F.col("views")).alias("program"), (F.col("views") > 2 * F.col("clicks")).alias("page"), (F.col("signups") > F.col("buys") + F.col("clicks")).alias("test"))
    return tours.tour(e, nodes, 0)
