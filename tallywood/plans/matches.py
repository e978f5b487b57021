"""Queries on multisets of lines, one-to-one matches and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, notes, rules
from .registry import query, table

_STOP = ("the", "and", "that", "for", "with", "was", "are", "this", "from", "que", "les", "des", "der", "die", "und", "los", "las")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of two snapshots of every source: documents with an even id before, with an odd id now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = rules.lines(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("body").alias("what"), (F.col("doc_id") * 100_000 + F.col("line")).alias("place"), (F.col("doc_id") % 2).alias("side"))
    rows = rows.filter(F.trim("what") != "")
    return rows.filter("side = 1").drop("side"), rows.filter("side = 0").drop("side")


_LINES = """
x AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS what, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
l AS (SELECT source, what, doc_id * 100000 + line AS place, doc_id % 2 AS side FROM x WHERE trim(what) <> '')
"""


@query(f"""WITH {_LINES}, b AS (SELECT source, what, count(*) AS n FROM l WHERE side = 0 GROUP BY ALL),
n AS (SELECT source, what, place, row_number() OVER (PARTITION BY source, what ORDER BY place) AS k FROM l WHERE side = 1)
SELECT n.source, n.what, n.place FROM n LEFT JOIN b ON n.source = b.source AND n.what = b.what WHERE k > coalesce(b.n, 0)""")
def guard_new_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source that are new, counting copies."""
    now, base = _sides(spark, sf_dir)
    return matching.unmatched(now, base, ["source", "what"], "place")


@query(f"WITH {_LINES} SELECT source, what FROM l WHERE side = 0 EXCEPT ALL SELECT source, what FROM l WHERE side = 1")
def guard_removed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source that are gone, counting copies."""
    now, base = _sides(spark, sf_dir)
    return base.select("source", "what").exceptAll(now.select("source", "what"))


@query("""
WITH b AS (SELECT p_brand, list_sort(list(DISTINCT p_type || ' ' || p_size % 25)) AS a FROM part WHERE p_size <= 25 GROUP BY 1), n AS (SELECT p_brand, list_sort(list(DISTINCT p_type || ' ' || p_size % 25)) AS a FROM part WHERE p_size > 25 GROUP BY 1)
SELECT b.p_brand, list_sort(list_filter(b.a, lambda x: NOT list_contains(coalesce(n.a, []), x))) AS lost FROM b LEFT JOIN n ON b.p_brand = n.p_brand
WHERE len(list_filter(b.a, lambda x: NOT list_contains(coalesce(n.a, []), x))) > 0""")
def lost_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries that a key has lost between two snapshots."""
    part = table(spark, sf_dir, "part").withColumn("entry", F.concat_ws(" ", "p_type", (F.col("p_size") % 25).cast("string")))
    b = part.filter("p_size <= 25").groupBy("p_brand").agg(F.collect_set("entry").alias("before"))
    n = part.filter("p_size > 25").groupBy("p_brand").agg(F.collect_set("entry").alias("now"))
    lost = F.sort_array(F.array_except("before", F.coalesce("now", F.array().cast("array<string>"))))
    return b.join(n, "p_brand", "left").select("p_brand", lost.alias("lost")).filter(F.size("lost") > 0)


@query("""
WITH a AS (SELECT text, doc_id AS gone, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT text, doc_id AS came, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1)
SELECT gone, came FROM a JOIN b ON a.text = b.text AND a.k = b.k""")
def rename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted documents matched one to one with new ones of the same bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return matching.paired(docs.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "gone"), docs.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "came"), ["digest"], "gone", "came")


@query("""
WITH r AS (SELECT doc_id, lower(regexp_extract(text, '^([^ .,]+)', 1)) AS word FROM documents),
t AS (SELECT lower(regexp_extract(text, '^([^ .,]+)', 1)) AS word, count(*) AS n, min(item_id) AS item_id FROM benchmark GROUP BY 1)
SELECT r.doc_id, r.word, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'edge' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN item_id END AS item_id
FROM r LEFT JOIN t ON r.word = t.word""")
def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resolved to the one test item that begins with the same word, if it is only one."""
    word = F.lower(F.regexp_extract("text", "^([^ .,]+)", 1)).alias("word")
    return matching.resolved(table(spark, sf_dir, "documents").select("doc_id", word), table(spark, sf_dir, "benchmark").select("item_id", word), "word", "doc_id", "item_id")


@query("""
WITH f AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages),
r AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
c AS (SELECT page_id, 0 AS nth, u || '/index' AS path FROM r UNION ALL SELECT page_id, 1, replace(u, '/en/', '/fr/') FROM r UNION ALL SELECT page_id, 2, u FROM r)
SELECT page_id, path, nth FROM c JOIN f USING (path) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY nth) = 1""")
def prioritized_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three candidate addresses of each page that exists."""
    u = F.regexp_replace("url", "[?#].*$", "")
    pages = table(spark, sf_dir, "pages")
    refs = pages.select("page_id", F.array(F.concat(u, F.lit("/index")), F.replace(u, F.lit("/en/"), F.lit("/fr/")), u).alias("tried"))
    return matching.prioritized(refs, pages.select(u.alias("path")), "tried", "path", "page_id")


def _token_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text"), _STOP).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.tokens(F.col("text"), _STOP).alias("tokens"))
    return a, b


_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}')), lambda x: x NOT IN (%s))" % ", ".join(f"'{x}'" for x in _STOP)
_PAIRS = f"""
a AS (SELECT doc_id AS l, len(k) AS ln, unnest(k) AS t FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)),
b AS (SELECT item_id AS r, len(k) AS rn, unnest(k) AS t FROM (SELECT item_id, {_TOKENS} AS k FROM benchmark)),
p AS (SELECT l, r, ln, rn, count(*) AS shared, list_sort(list(t))[1:12] AS shared_tokens FROM a JOIN b USING (t) GROUP BY l, r, ln, rn),
k AS (SELECT *, shared / (ln + rn - shared)::DOUBLE AS j, shared / least(ln, rn)::DOUBLE AS o FROM p),
m AS (SELECT l, r, shared, round(j, 3) AS jaccard, round(o, 3) AS overlap,
  CASE WHEN j >= 0.35 OR (o >= 0.6 AND shared >= 8) THEN 'duplicate' WHEN j >= 0.15 OR (o >= 0.4 AND shared >= 5) THEN 'sibling' END AS kind, shared_tokens FROM k)
"""


@query(f"WITH {_PAIRS} SELECT * FROM m WHERE kind IS NOT NULL")
def collate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and test items that share enough words."""
    return matching.similar(*_token_sets(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT kind, count(*) AS n, count(DISTINCT l) AS docs, max(jaccard) AS best FROM m WHERE kind IS NOT NULL GROUP BY kind")
def collate_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.similar(*_token_sets(spark, sf_dir))
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l").alias("docs"), F.max("jaccard").alias("best"))


@query("""
WITH w AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents),
n AS (SELECT source, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS word, min(doc_id) AS owner FROM documents GROUP BY ALL)
SELECT w.doc_id, w.word, n.owner FROM w JOIN n ON w.source = n.source AND w.word = n.word WHERE length(n.word) >= 4 AND n.owner <> w.doc_id""")
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name another one of the same source by its first word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = docs.select("source", F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("word"), "doc_id").filter(F.length("word") >= 4).groupBy("source", "word").agg(F.min("doc_id").alias("owner"))
    words = docs.select("source", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})")))).alias("word"))
    return words.join(names, ["source", "word"]).filter("owner <> doc_id").select("doc_id", "word", "owner")


#: Words of the given prose after which a turn or a test item names something.
_CUES = ("with", "from", "for")


def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations and test items: name (their first three words), tokens and triggers."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index("text", " ", 3)), "[^a-z]+", "-"), "^-+|-+$", "")
    shaped = lambda df, id: df.select(id.alias("id"), name.alias("name"), T.tokens(F.col("text"), _STOP).alias("tokens"), notes.phrases(F.col("text"), _CUES).alias("triggers"))
    return shaped(table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn")), shaped(table(spark, sf_dir, "benchmark"), F.col("item_id"))


_CLEAN = "trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))"
_RELATED = rf"""
items AS (SELECT 'l' AS side, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'r', item_id, text FROM benchmark),
shaped AS (SELECT side, id, trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^a-z]+', '-', 'g'), '-') AS name, {_TOKENS} AS tokens,
  list_concat(regexp_extract_all(text, '"([^"\n]+)"', 1), list_filter(regexp_split_to_array(text, '[\s,.;:()"'']+'), lambda x: regexp_matches(x, '^/[a-z][a-z0-9-]+$')),
    list_transform(regexp_split_to_array(text, '[,.;:()\n]|\s(?:or|nor|and)\s'), lambda x: regexp_extract(x, '(?i)\b(?:{"|".join(_CUES)})\s+([A-Za-z0-9].*)$', 1))) AS said FROM items),
d AS (SELECT *, list_filter(list_distinct(list_transform(said, lambda x: {_CLEAN})), lambda x: length(x) BETWEEN 3 AND 60) AS triggers,
  list_filter(list_distinct(string_split(name, '-')), lambda x: x NOT IN ('and', 'skill', 'skills', 'the')) AS parts FROM shaped),
p AS (SELECT a.id AS l, b.id AS r, a.name AS an, b.name AS bn, list_sort(list_intersect(a.tokens, b.tokens)) AS shared, len(a.tokens) AS n, len(b.tokens) AS m,
  list_sort(list_intersect(a.triggers, b.triggers)) AS st, len(list_intersect(a.parts, b.parts)) AS np FROM d a, d b WHERE a.side = 'l' AND b.side = 'r'),
k AS (SELECT *, len(shared) AS s, CASE WHEN n + m > 0 THEN len(shared) / (n + m - len(shared))::DOUBLE ELSE 0 END AS j, CASE WHEN least(n, m) > 0 THEN len(shared) / least(n, m)::DOUBLE ELSE 0 END AS o FROM p),
h AS (SELECT *, an = bn OR (length(an) > 5 AND contains(bn, an)) OR (length(bn) > 5 AND contains(an, bn)) OR (np >= 2 AND (j >= 0.05 OR len(st) > 0)) AS hit FROM k),
c AS (SELECT l, r, CASE WHEN an = bn OR (len(st) > 0 AND j >= 0.2) OR j >= 0.35 OR (o >= 0.6 AND s >= 8) THEN 'duplicate' WHEN hit OR len(st) > 0 OR j >= 0.15 OR (o >= 0.4 AND s >= 5) THEN 'sibling' END AS kind,
  round(j, 3) AS jaccard, round(o, 3) AS overlap, shared[1:12] AS shared_tokens, st AS shared_triggers, an = bn AS same_name FROM h)
"""


@query(f"WITH {_RELATED} SELECT *, row_number() OVER (ORDER BY kind <> 'duplicate', -jaccard, l, r) AS place FROM c WHERE kind IS NOT NULL")
def collate_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and test items of one kind, by name, trigger phrases and words, duplicates first."""
    return matching.collated(matching.related(*_described(spark, sf_dir)))
