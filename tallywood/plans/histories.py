"""Queries on captures, versions, islands and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from .registry import query, table


def captures(events: DataFrame) -> DataFrame:
    """Events as captures: the result by the type, the value as metric, the properties as bound."""
    result = F.when(F.col("event_type").isin("purchase", "signup"), "pass").when(F.col("event_type") == "error", "fail").otherwise("other")
    return events.select("user_id", "ts", "event_id", result.alias("result"), F.round("value", 2).alias("metric"), F.col("props").alias("bound"))


@query("""
WITH c AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'pass' WHEN event_type = 'error' THEN 'fail' ELSE 'other' END AS result,
    round(value, 2) AS metric, props AS bound FROM events),
p AS (SELECT *, lag(result) OVER w AS prev_result, lag(metric) OVER w AS prev_metric, lag(bound) OVER w AS prev_bound, row_number() OVER w AS nth FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN nth = 1 THEN 'nothing to compare' WHEN prev_result IS NOT DISTINCT FROM result THEN 'same' WHEN result = 'pass' THEN 'improved' ELSE 'REGRESSION' END AS moved,
  round(metric - prev_metric, 4) AS delta,
  coalesce(prev_metric <> 0 AND abs(metric - prev_metric) / greatest(abs(prev_metric), 1) > 0.25, false) AS worth_a_look,
  coalesce(length(bound) < 0.6 * length(prev_bound), false) AS bound_shrunk FROM p""")
def capture_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the one before of the same user."""
    rows = sequence.with_previous(captures(table(spark, sf_dir, "events")), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", "moved", "delta", "worth_a_look", "bound_shrunk")


@query("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL""")
def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return sequence.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts"], ["event_id", "value"])


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 36 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, 1 + sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY ALL""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with no gap of more than 36 hours."""
    far = F.col("ts") - F.col("prev_ts") > F.expr("INTERVAL '36' HOUR")
    rows = sequence.islands(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], far)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT p.event_id, p.user_id, p.ts, v.event_id AS version FROM (SELECT * FROM events WHERE event_type = 'error') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error with the user's purchase that was the newest at the time."""
    events = table(spark, sf_dir, "events")
    probes = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    versions = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("version"))
    return sequence.as_of(probes, versions, ["user_id"], "ts", "version").select("event_id", "user_id", "ts", "version")


@query("""
SELECT user_id, event_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'purchase'""")
def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time each purchase was a user's newest."""
    rows = sequence.valid_from(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), ["user_id"], "ts", "event_id")
    return rows.select("user_id", "event_id", "since", "until")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty lines either way of a pointer: suppliers' parts as paths, order numbers as lines."""
    line = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_quantity < 10")
    at = F.col("l_orderkey") % 5000 + 1
    return line.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("id"), F.greatest(F.lit(1), at - 30).cast("long").alias("lo"), (at + 30).cast("long").alias("hi")).distinct()


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2 AND l_discount > 0.08")
    return line.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 5000 + 1).cast("long").alias("start"), (F.col("l_quantity") % 7).cast("long").alias("len"), (F.col("l_quantity") % 5).cast("long").alias("new_len")).distinct()


_SPANS = """
WITH r AS (SELECT DISTINCT l_suppkey AS path, l_orderkey AS id, greatest(1, l_orderkey % 5000 + 1 - 30)::BIGINT AS lo, (l_orderkey % 5000 + 1 + 30)::BIGINT AS hi FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 10),
h AS (SELECT DISTINCT l_suppkey AS path, (l_orderkey % 5000 + 1)::BIGINT AS start, (l_quantity % 7)::BIGINT AS len, (l_quantity % 5)::BIGINT AS new_len FROM lineitem WHERE l_linenumber = 2 AND l_discount > 0.08)
"""


@query(_SPANS + "SELECT r.path, r.id, count(*) AS hits FROM r JOIN h ON r.path = h.path AND h.start <= r.hi AND h.start + greatest(h.len, 1) - 1 >= r.lo GROUP BY ALL")
def region_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that some hunk of the same path overlaps."""
    return sequence.stale(regions(spark, sf_dir), hunks(spark, sf_dir))


@query(_SPANS + """
SELECT r.path, r.id, r.lo, r.hi, CASE WHEN NOT bool_or(coalesce(m, false)) THEN r.lo + coalesce(sum(s), 0) END::BIGINT AS new_lo,
  CASE WHEN NOT bool_or(coalesce(m, false)) THEN r.hi + coalesce(sum(s), 0) END::BIGINT AS new_hi, bool_or(coalesce(m, false)) AS changed
FROM (SELECT r.*, h.start <= r.hi AND h.start + greatest(h.len, 1) - 1 >= r.lo AS m, CASE WHEN h.start + greatest(h.len, 1) - 1 < r.lo THEN new_len - len ELSE 0 END AS s
      FROM r LEFT JOIN h ON r.path = h.path) r GROUP BY r.path, r.id, r.lo, r.hi""")
def line_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers carried across the hunks of their path."""
    return sequence.carried(regions(spark, sf_dir), hunks(spark, sf_dir).select("path", F.col("start").alias("old_start"), F.col("len").alias("old_len"), "new_len"))


@query(_SPANS + """,
w AS (SELECT *, max(hi) OVER (PARTITION BY path ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
n AS (SELECT *, sum(CASE WHEN lo <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY lo, hi, id) AS n FROM w)
SELECT path, min(lo) AS lo, max(hi) AS hi, count(*) AS spans FROM n GROUP BY path, n""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping regions of a path merged."""
    return sequence.merged(regions(spark, sf_dir), ["path"])


@query("""
SELECT vec_id, round((label + 1) / (1.0 + (SELECT max(label) + 1 FROM embeddings)), 6) AS p,
  CASE WHEN round((label + 1) / (1.0 + (SELECT max(label) + 1 FROM embeddings)), 6) < 0.3 THEN 'low' WHEN round((label + 1) / (1.0 + (SELECT max(label) + 1 FROM embeddings)), 6) < 0.7 THEN 'torn' ELSE 'high' END AS band,
  least(abs(round((label + 1) / (1.0 + (SELECT max(label) + 1 FROM embeddings)), 6) - 0.3), abs(round((label + 1) / (1.0 + (SELECT max(label) + 1 FROM embeddings)), 6) - 0.7)) <= 0.08 AS near FROM embeddings""")
def judge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in bands: low under 0.30, torn under 0.70, high; near within 0.08 of a bound."""
    from ..functions.text import judgment

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = rows.agg((F.max("label") + 1).alias("m"))  # one row
    p = F.round((F.col("label") + 1) / (1.0 + F.col("m")), 6)
    band, near = judgment(F.col("p"))
    return rows.join(F.broadcast(top)).select("vec_id", p.alias("p")).withColumns({"band": band, "near": near})


#: Nested spans of lines: a key's aligned block of 1, 4, 16, … lines, by the number of its line; suppliers' parts are the paths.
_NESTED = """
s AS (SELECT DISTINCT l_suppkey AS path, (l_orderkey % 5000) - (l_orderkey % 5000) % (4 ** l_linenumber)::BIGINT AS lo, (4 ** l_linenumber)::BIGINT AS n FROM lineitem),
s2 AS (SELECT path, n AS id, lo, lo + n - 1 AS hi FROM s),
p AS (SELECT DISTINCT l_suppkey AS path, l_partkey % 5000 AS at FROM lineitem)
"""


@query(f"""WITH {_NESTED} SELECT p.path, p.at, s2.id, s2.lo, s2.hi FROM p LEFT JOIN s2 ON s2.path = p.path AND p.at BETWEEN s2.lo AND s2.hi
QUALIFY row_number() OVER (PARTITION BY p.path, p.at ORDER BY s2.lo DESC, s2.hi, s2.id DESC) = 1""")
def innermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of the nested spans of a path that holds each of its places."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), "l_orderkey", "l_partkey", F.pow(F.lit(4), F.col("l_linenumber")).cast("long").alias("n"))
    at = F.col("l_orderkey") % 5000
    spans = item.select("path", F.col("n").alias("id"), (at - at % F.col("n")).alias("lo"), (at - at % F.col("n") + F.col("n") - 1).alias("hi")).distinct()
    return sequence.innermost(spans, item.select("path", (F.col("l_partkey") % 5000).alias("at")).distinct())
