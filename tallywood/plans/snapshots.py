"""Queries on snapshots, one-sided keys, ceilings and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, snapshot
from .registry import query, table


def _window(spark: SparkSession, sf_dir: str, first: str, last: str) -> DataFrame:
    """Customers with an order in [first, last): segment and the status of the latest order."""
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(last).cast("timestamp_ntz")))
    latest = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m")).select("c_custkey", F.col("m.o_orderstatus").alias("grade"))
    return latest.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("face")), "c_custkey")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _window(spark, sf_dir, "1996-01-01", "1996-07-01"), _window(spark, sf_dir, "1996-07-01", "1997-01-01")
    return snapshot.compare(a, b, "c_custkey", [("face", "face changed"), ("grade", "regraded")])


_SNAPSHOT_SQL = """
WITH o AS (
  SELECT o_custkey, o_orderstatus, o_orderdate < TIMESTAMP '1996-07-01' AS early, o_orderdate, o_orderkey
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
), latest AS (
  SELECT o_custkey, early, o_orderstatus AS grade FROM o
  QUALIFY row_number() OVER (PARTITION BY o_custkey, early ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
), a AS (SELECT o_custkey AS k, grade, c_mktsegment AS face FROM latest JOIN customer ON o_custkey = c_custkey WHERE early),
b AS (SELECT o_custkey AS k, grade, c_mktsegment AS face FROM latest JOIN customer ON o_custkey = c_custkey WHERE NOT early),
compared AS (
  SELECT coalesce(a.k, b.k) AS c_custkey, a.face AS face_before, b.face AS face_after, a.grade AS grade_before, b.grade AS grade_after,
    CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.face IS DISTINCT FROM b.face THEN 'face changed'
         WHEN a.grade IS DISTINCT FROM b.grade THEN 'regraded' ELSE 'same' END AS change
  FROM a FULL JOIN b ON a.k = b.k)
"""


@query(_SNAPSHOT_SQL + "SELECT * FROM compared")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ordered in either half of 1996, compared by the status of their latest order."""
    return _compared(spark, sf_dir)


@query(_SNAPSHOT_SQL + """
SELECT coalesce(face_after, face_before) AS face, count(*) FILTER (WHERE change = 'added') AS added,
  count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'regraded') AS regraded,
  count(*) FILTER (WHERE change = 'same') AS same FROM compared GROUP BY 1""")
def snapshot_by_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those changes counted by market segment."""
    face = F.coalesce("face_after", "face_before").alias("face")
    return _compared(spark, sf_dir).groupBy(face).agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "regraded", "same")])


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
  coalesce(CASE WHEN l.toxic = 1 THEN 'dev' WHEN l.quality = 1 THEN 'user' END, CASE WHEN d.lang = 'en' THEN 'user' ELSE 'rest' END) AS face,
  l.quality AS grade, CASE WHEN l.doc_id IS NULL THEN 'derived' WHEN d.doc_id IS NULL THEN 'authored' ELSE 'both' END AS origin,
  CASE coalesce(CASE WHEN l.toxic = 1 THEN 'dev' WHEN l.quality = 1 THEN 'user' END, CASE WHEN d.lang = 'en' THEN 'user' ELSE 'rest' END)
    WHEN 'user' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END AS rank
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def entries_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels as derived and authored entries, with the order of their faces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "user").otherwise("rest").alias("face"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "dev").when(F.col("quality") == 1, "user").alias("face"), F.col("quality").alias("grade"))
    return snapshot.listed(docs, labels, "doc_id", ["user", "dev"])


@query("""
WITH n AS (SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source),
c(source, ceiling) AS (VALUES ('src0', 20), ('src1', 30), ('src2', 40), ('src3', 31), ('src99', 3))
SELECT coalesce(n.source, c.source) AS source, coalesce(n, 0) AS n, ceiling::BIGINT AS ceiling,
  CASE WHEN ceiling IS NULL THEN CASE WHEN coalesce(n, 0) > 0 THEN 'no ceiling' ELSE 'ok' END WHEN coalesce(n, 0) > ceiling THEN 'over'
       WHEN coalesce(n, 0) < ceiling THEN 'can tighten' ELSE 'ok' END AS verdict, least(ceiling, coalesce(n, 0))::BIGINT AS next_ceiling
FROM n FULL JOIN c ON n.source = c.source""")
def unmapped_vs_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, counted by source and held against ceilings."""
    free = snapshot.unmapped(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    ceilings = spark.createDataFrame([("src0", 20), ("src1", 30), ("src2", 40), ("src3", 31), ("src99", 3)], "source string, ceiling long")
    return ledger.ratcheted(free.groupBy("source").agg(F.count(F.lit(1)).alias("n")), ceilings, "source")


@query("""
WITH sold AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-15'),
orphans AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey NOT IN (SELECT k FROM sold)),
alive AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey IN (SELECT k FROM sold)),
ranked AS (
  SELECT o.p_partkey, 1 AS priority, 0 AS distance, a.p_partkey AS successor FROM orphans o JOIN alive a ON a.p_brand = o.p_brand AND a.p_size = o.p_size
  UNION ALL SELECT o.p_partkey, 2, abs(a.p_size - o.p_size), a.p_partkey FROM orphans o JOIN alive a ON a.p_brand = o.p_brand AND abs(a.p_size - o.p_size) BETWEEN 1 AND 5),
picked AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority, distance, successor) = 1)
SELECT o.p_partkey, r.successor, r.priority, r.distance FROM orphans o LEFT JOIN picked r ON o.p_partkey = r.p_partkey""")
def orphans_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts no longer shipped, with the part that takes their place: same brand and size, else the nearest size within 5."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    sold = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("2001-09-15").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    orphans, alive = snapshot.unmapped(parts, sold, "p_partkey"), parts.join(sold, "p_partkey", "left_semi")
    # one row for each brand and size, so an orphan meets eleven candidates at most
    heads = alive.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("successor"))
    near = orphans.withColumn("size", F.explode(F.sequence(F.col("p_size") - 5, F.col("p_size") + 5))).join(heads, ["p_brand", "size"])
    near = near.withColumn("distance", F.abs(F.col("size") - F.col("p_size"))).withColumn("priority", F.when(F.col("distance") == 0, 1).otherwise(2))
    picked = snapshot.best(near, ["p_partkey"], [F.col("priority"), F.col("distance"), F.col("successor")], ["successor", "priority", "distance"])
    return orphans.select("p_partkey").join(picked, "p_partkey", "left").select("p_partkey", "successor", "priority", "distance")


@query("""
WITH d AS (SELECT DISTINCT s_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 7000),
r AS (SELECT DISTINCT c_nationkey AS nation, n_regionkey AS region FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 498000)
SELECT coalesce(d.nation, r.nation) AS nation, coalesce(d.region, r.region) AS region, CASE WHEN r.nation IS NULL THEN 'not read' ELSE 'not declared' END AS gap
FROM d FULL JOIN r ON d.nation = r.nation AND d.region = r.region WHERE d.nation IS NULL OR r.nation IS NULL""")
def declared_vs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with suppliers against nations with large orders: what only one side has."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    d = table(spark, sf_dir, "supplier").filter("s_acctbal > 7000").select(F.col("s_nationkey").alias("nation")).join(nation, "nation")
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 498000").select(F.col("o_custkey").alias("c_custkey"))
    r = table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("nation")).join(nation, "nation")
    return snapshot.one_sided(d, r, ["nation", "region"])


_ITEMS = [
    ("suppression", "src0", "fr", "accepted", "old text", None, 1), ("suppression", "src0", "fr", "accepted", "again", None, 2),
    ("suppression", "src1", "de", "waived", "ported", "lee", 3), ("suppression", "src2", "en", "waived", "no signer here", None, 4),
    ("suppression", "src3", "es", "perhaps", "what", None, 5), ("suppression", "src4", "en", "accepted", " ", None, 6),
    ("suppression", "src98", "en", "accepted", "gone since", None, 7),
]
_FINDINGS_SQL = "SELECT 'suppression' AS kind, source AS file, lang AS what FROM documents WHERE n_chars < 600"


@query(f"""
WITH findings AS ({_FINDINGS_SQL}),
items(kind, file, what, verdict, why, "by", seq) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _ITEMS)}),
judged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY kind, file, what ORDER BY seq) > 1 THEN 'duplicate'
    WHEN verdict NOT IN ('accepted', 'waived') THEN 'unknown verdict' WHEN trim(why) = '' THEN 'no reason'
    WHEN verdict = 'waived' AND coalesce("by", '') = '' THEN 'no signer' END AS fault FROM items)
SELECT f.kind, f.file, f.what, 'finding' AS side, CASE WHEN j.kind IS NULL THEN 'open' ELSE 'excused' END AS status
FROM findings f LEFT JOIN (SELECT * FROM judged WHERE fault IS NULL) j ON (f.kind, f.file, f.what) = (j.kind, j.file, j.what)
UNION ALL SELECT j.kind, j.file, j.what, 'item', coalesce(fault, CASE WHEN EXISTS (SELECT 1 FROM findings f WHERE (f.kind, f.file, f.what) = (j.kind, j.file, j.what)) THEN 'ok' ELSE 'stale' END)
FROM judged j""")
def guard_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents as findings, reconciled with a ledger of excuses."""
    findings = table(spark, sf_dir, "documents").filter("n_chars < 600").select(F.lit("suppression").alias("kind"), F.col("source").alias("file"), F.col("lang").alias("what"))
    items = spark.createDataFrame(_ITEMS, "kind string, file string, what string, verdict string, why string, `by` string, seq long")
    return ledger.reconciled(findings, items, ["kind", "file", "what"], {"accepted": False, "waived": True})


@query("""
SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown grade'
  WHEN role IN ('user', 'assistant') AND length(trim(text)) < 40 THEN 'no observable' END AS refusal
FROM conversations WHERE role NOT IN ('user', 'assistant', 'system') OR (role IN ('user', 'assistant') AND length(trim(text)) < 40)""")
def record_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns a validated append would refuse: an unknown role, or a spoken one that says next to nothing."""
    role = F.col("role")
    why = F.when(~role.isin("user", "assistant", "system"), "unknown grade").when(role.isin("user", "assistant") & (F.length(F.trim("text")) < 40), "no observable")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", why.alias("refusal")).filter("refusal IS NOT NULL")


@query("""
SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
  count(*) FILTER (WHERE lang = 'en') AS en_files, count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and lines by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"),
        F.count(F.when(F.col("lang") == "en", 1)).alias("en_files"), F.countDistinct("lang").alias("langs"),
    )


@query("""
WITH g AS (SELECT p_brand || '/' || p_size AS id, min(p_partkey) AS first_key, count(*) AS n, list(p_partkey ORDER BY p_partkey) AS ks FROM part GROUP BY 1)
SELECT id, first_key, ks[2:6] AS others, n FROM g""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each brand and size: the first part, the next five, and how many there are.

    The six smallest keys come from a rank within salted groups first, so no group meets whole.
    """
    from ..operators.sequence import smallest

    parts = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("id"), "p_partkey")
    firsts = smallest(parts, ["id"], "p_partkey", 6)
    return firsts.select("id", F.col("first")[0].alias("first_key"), F.slice("first", 2, 5).alias("others"), "n")
