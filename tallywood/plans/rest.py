"""Queries on pins, provenance rows, thresholds, siblings and callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table


@query("""
WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'maxDelay' WHEN 1 THEN 'min_size' WHEN 2 THEN 'coverage' ELSE 'plain' END AS key, p_size AS a, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE (p_partkey * 7) % 50 + 1 END AS n FROM part),
d AS (SELECT *, CASE key WHEN 'maxDelay' THEN 'up' WHEN 'min_size' THEN 'down' WHEN 'coverage' THEN 'down' END AS looser FROM b)
SELECT p_partkey, key, a::DOUBLE AS before, n::DOUBLE AS after, looser FROM d WHERE (looser = 'up' AND n > a) OR (looser = 'down' AND n < a)""")
def loosened_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two snapshots with the same skeleton whose number moved the loose way."""
    k = F.col("p_partkey") % 4
    key = F.when(k == 0, "maxDelay").when(k == 1, "min_size").when(k == 2, "coverage").otherwise("plain")
    after = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")).otherwise((F.col("p_partkey") * 7) % 50 + 1)
    line = lambda n: F.concat(F.lit("p"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"), F.lit("."), F.col("key"), F.lit(": "), n.cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", key.alias("key"), F.col("p_size").alias("a"), after.alias("n"))
    b = part.select("p_partkey", "key", line(F.col("a")).alias("old"))
    n = part.select(line(F.col("n")).alias("new"))
    pairs = b.withColumn("s", T.skeleton(F.col("old"))).join(n.withColumn("s", T.skeleton(F.col("new"))), "s")
    pairs = pairs.select("p_partkey", "key", T.numbers(F.col("old"))[0].alias("before"), T.numbers(F.col("new"))[0].alias("after"), T.direction(F.col("key"), F.lit(""), F.lit("")).alias("looser"))
    return pairs.filter(((F.col("looser") == "up") & (F.col("after") > F.col("before"))) | ((F.col("looser") == "down") & (F.col("after") < F.col("before"))))


@query("""
WITH c AS (SELECT event_id, sha1(event_id::VARCHAR) AS sha FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, left(sha1(max(event_id)::VARCHAR), (7 + user_id % 20)::INT) AS pin FROM events GROUP BY user_id)
SELECT p.user_id, p.pin, c.event_id AS head FROM p LEFT JOIN c ON starts_with(c.sha, p.pin)""")
def pinned_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, which are prefixes of seven digits or more, with the commit they name: an equi-join on seven digits first."""
    events = table(spark, sf_dir, "events")
    sha = lambda c: F.sha1(F.col(c).cast("string").cast("binary"))
    c = events.filter("event_type = 'purchase'").select("event_id", sha("event_id").alias("sha")).withColumn("k", F.substring("sha", 1, 7))
    p = events.groupBy("user_id").agg(F.max("event_id").alias("m")).select("user_id", F.substring(sha("m"), F.lit(1), (7 + F.col("user_id") % 20).cast("int")).alias("pin")).withColumn("k", F.substring("pin", 1, 7))
    return p.join(c, (p.k == c.k) & F.startswith(c.sha, p.pin), "left").select("user_id", "pin", F.col("event_id").alias("head"))


@query("""
SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no source' WHEN NOT regexp_matches(left(sha1(text), (4 + turn % 9)::INT), '^[0-9a-f]{7,40}$') THEN 'commit'
  WHEN role NOT IN ('user', 'assistant') THEN 'verdict' WHEN length(text) < 60 THEN 'no reason' END AS refusal FROM conversations""")
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as provenance rows, each with the first reason to refuse it, or none."""
    commit = F.substring(F.sha1(F.col("text").cast("binary")), F.lit(1), (4 + F.col("turn") % 9).cast("int"))
    why = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no source").when(~commit.rlike("^[0-9a-f]{7,40}$"), "commit").when(~F.col("role").isin("user", "assistant"), "verdict").when(F.length("text") < 60, "no reason")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", why.alias("refusal"))


@query(r"""
WITH s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://(?:m\.)?([^/]+/[a-z]*)', 1) AS stem, regexp_matches(url, '[?#]') AS compiled FROM pages)
SELECT c.page_id, min(o.page_id) AS source_page FROM s c JOIN s o ON c.stem = o.stem WHERE c.compiled AND NOT o.compiled GROUP BY c.page_id""")
def compiled_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a query or a fragment beside a plain one of the same stem: host and first folder."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://(?:m\.)?([^/]+/[a-z]*)", 1).alias("stem"), F.col("url").rlike("[?#]").alias("compiled"))
    plain = pages.filter("NOT compiled").groupBy("stem").agg(F.min("page_id").alias("source_page"))
    return pages.filter("compiled").join(plain, "stem").select("page_id", "source_page")


@query(r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents),
e AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{6,})', 1)) AS word FROM benchmark)
SELECT e.word, min(w.doc_id) AS caller, count(w.doc_id) AS callers FROM e LEFT JOIN w ON e.word = w.word WHERE e.word <> '' GROUP BY e.word""")
def first_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name the first document that says it, as a whole word: an equi-join on words, not a search per pair."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("word"))
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "([A-Za-z]{6,})", 1)).alias("word")).filter("word <> ''").distinct()
    met = words.join(names, "word").groupBy("word").agg(F.min("doc_id").alias("caller"), F.count(F.lit(1)).alias("callers"))
    return names.join(met, "word", "left").select("word", "caller", F.coalesce("callers", F.lit(0).cast("long")).alias("callers"))


@query("SELECT CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN toxic = 1 THEN 'ASSERTED' WHEN quality = 1 THEN 'DRIVEN' ELSE 'TESTED' END AS grade, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by grade, as counts and never as a share."""
    grade = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("toxic") == 1, "ASSERTED").when(F.col("quality") == 1, "DRIVEN").otherwise("TESTED")
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))
