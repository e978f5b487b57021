"""Queries that scan text by rules, and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, mentions, rules, sequence
from .registry import query, table


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.matching(rules.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))


_RULES = ", ".join(f"('{r.category}', '{r.label}', '{r.scope}', '{r.pattern}')" for r in rules.RULES)
_SCAN = f"""
rules(category, label, scope, pattern) AS (VALUES {_RULES}),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents),
h AS (SELECT doc_id, line, body, category, label, scope, regexp_extract_all(body, pattern) AS ms FROM x, rules WHERE regexp_matches(body, pattern))
"""


@query(f"WITH {_SCAN} SELECT doc_id, line, category, label, left(array_to_string(ms, ' | '), 120) AS match, len(ms) AS n FROM h")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's flags by the rules."""
    return rules.flags(_matches(spark, sf_dir), ["doc_id", "line"])


@query(f"WITH {_SCAN} SELECT category, label, count(*) AS lines, sum(len(ms))::BIGINT AS n, count(DISTINCT doc_id) AS docs FROM h GROUP BY ALL")
def rule_scan_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rules.flags(_matches(spark, sf_dir), ["doc_id", "line"])
    return f.groupBy("category", "label").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").cast("long").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""WITH {_SCAN}, o AS (SELECT *, unnest(ms) AS match FROM h)
SELECT doc_id, line, category, label, match, CASE WHEN scope = 'prose' AND contains(body, ' | ') THEN 'table'
  WHEN scope = 'affirmed' AND regexp_matches(regexp_extract(string_split(body, match)[1], '([^.,;:!?]*)$', 1), '(?i)(?:^|[^a-z])(?:not|no|never|nicht|pas|non)(?:[^a-z]|$)') THEN 'denied' END AS why FROM o""")
def rule_scan_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with the context that covers it, or none."""
    return rules.gated(_matches(spark, sf_dir), "doc_id")


@query(r"""
WITH c(source, ceiling) AS (VALUES ('src0', 10), ('src1', 0), ('src2', 500), ('src77', 4)),
n AS (SELECT source, sum(len(regexp_extract_all(text, '[$%&*#]{3}')))::BIGINT AS n FROM documents GROUP BY source)
SELECT coalesce(n.source, c.source) AS source, coalesce(n, 0) AS n, ceiling::BIGINT AS ceiling, CASE WHEN ceiling IS NULL THEN CASE WHEN coalesce(n, 0) > 0 THEN 'no ceiling' ELSE 'ok' END
  WHEN coalesce(n, 0) > ceiling THEN 'over' WHEN coalesce(n, 0) < ceiling THEN 'can tighten' ELSE 'ok' END AS verdict, least(ceiling, coalesce(n, 0))::BIGINT AS next_ceiling
FROM n FULL JOIN c ON n.source = c.source""")
def pattern_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of one pattern by source, held against ceilings that may only go down."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(rules.hits(r"[$%&*#]{3}", F.col("text"))).cast("long").alias("n"))
    ceilings = spark.createDataFrame([("src0", 10), ("src1", 0), ("src2", 500), ("src77", 4)], "source string, ceiling long")
    return ledger.ratcheted(counts, ceilings, "source")


@query(f"""WITH {_SCAN}, f AS (SELECT category, label, doc_id * 100000 + line AS pos FROM h)
SELECT category, label, list_sort(list(pos))[1:5] AS first, count(*) AS n FROM f GROUP BY category, label""")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five places of each label, and how many there are."""
    rows = _matches(spark, sf_dir).select("category", "label", (F.col("doc_id") * 100_000 + F.col("line")).alias("pos"))
    return sequence.smallest(rows, ["category", "label"], "pos", 5)


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(left(text, 6000), '(?i)apache license') THEN 'Apache-2.0' WHEN regexp_matches(left(text, 6000), '(?i)general public license') THEN 'GPL'
  WHEN regexp_matches(left(text, 6000), '(?i)mit license') THEN 'MIT' WHEN regexp_matches(left(text, 6000), 'CC BY') THEN 'CC' WHEN regexp_matches(left(text, 6000), '(?i)all rights reserved') THEN 'none granted' END AS kind FROM documents""")
def license_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first grant, in order of precedence, in a text's first 6,000 characters, which is the feature."""
    head = F.substring("text", 1, 6000)
    kind = F.when(head.rlike("(?i)apache license"), "Apache-2.0").when(head.rlike("(?i)general public license"), "GPL").when(head.rlike("(?i)mit license"), "MIT").when(head.rlike("CC BY"), "CC").when(head.rlike("(?i)all rights reserved"), "none granted")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query(r"""
WITH p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'src/tests/' || lang || '.py' WHEN 1 THEN 'src/' || lang || '.test.ts' WHEN 2 THEN 'fixtures/' || lang || '.md' WHEN 3 THEN 'src/conftest.py' WHEN 4 THEN 'tests/__init__.py' WHEN 5 THEN 'src/test_' || lang || '.py' ELSE 'src/' || lang || '.py' END AS path FROM documents),
g AS (SELECT *, regexp_matches(path, '\.(?:py|js|jsx|ts|tsx|mjs|cjs)$') AND (regexp_matches(path, '(?:^|/)tests?/') OR regexp_matches(path, '(?:^|/)(?:test_[^/]*|[^/]*_test|[^/]*\.(?:test|spec)|conftest)\.[a-z]+$')) AS in_graph FROM p)
SELECT path, count(*) AS n, bool_or(in_graph) AS in_graph, bool_or(regexp_matches(path, '(?:^|/)(?:tests?|__tests__)/|\.(?:test|spec)\.')) AS in_map,
  bool_or(regexp_matches(path, '(?i)(?:^|/)(?:tests?|__tests__|fixtures|e2e)/|\.(?:test|spec)\.|(?:^|[/_])selftest')) AS in_scan,
  bool_or(in_graph AND NOT regexp_matches(path, '(?:^|/)(?:conftest|__init__|setup)\.py$')) AS in_guard FROM g GROUP BY path""")
def test_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four predicates for "is a test" on made-up paths."""
    lang, k = F.col("lang"), F.col("doc_id") % 7
    c = F.concat
    path = F.when(k == 0, c(F.lit("src/tests/"), lang, F.lit(".py"))).when(k == 1, c(F.lit("src/"), lang, F.lit(".test.ts"))).when(k == 2, c(F.lit("fixtures/"), lang, F.lit(".md"))).when(k == 3, "src/conftest.py").when(k == 4, "tests/__init__.py").when(k == 5, c(F.lit("src/test_"), lang, F.lit(".py"))).otherwise(c(F.lit("src/"), lang, F.lit(".py")))
    p = table(spark, sf_dir, "documents").select(path.alias("path"))
    x = F.col("path")
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(T.test_in_graph(x)).alias("in_graph"), F.bool_or(T.test_in_map(x)).alias("in_map"), F.bool_or(T.test_in_scan(x)).alias("in_scan"), F.bool_or(T.test_in_guard(x)).alias("in_guard"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS slug,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host,
  regexp_replace(url, '\d+(?:\.\d+)?', '#', 'g') AS skeleton,
  CASE WHEN html = '' THEN 0 ELSE length(html) - length(replace(html, chr(10), '')) + CASE WHEN ends_with(html, chr(10)) THEN 0 ELSE 1 END END AS lines,
  CASE WHEN length(trim(html)) > 160 THEN left(trim(html), 160) || '...' ELSE trim(html) END AS excerpt FROM pages""")
def page_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, host, number skeleton, line count and excerpt of each page."""
    u, h = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.slug(u).alias("slug"), T.host(u).alias("host"), T.skeleton(u).alias("skeleton"), T.line_count(h).cast("long").alias("lines"), T.excerpt(h).alias("excerpt"))


@query("""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN (event_id % 100)::VARCHAR || '.5' WHEN 2 THEN event_type ELSE '1.5x' END AS raw FROM events),
n AS (SELECT event_id, raw, CASE WHEN contains(raw, '.') THEN try_cast(raw AS DOUBLE) ELSE try_cast(raw AS BIGINT)::DOUBLE END AS num FROM r)
SELECT *, CASE WHEN num IS NULL THEN 'text' WHEN contains(raw, '.') THEN 'float' ELSE 'int' END AS kind FROM n""")
def metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of mixed type: the text, its number if it is one, and its kind."""
    k, i = F.col("event_id") % 4, F.col("event_id")
    raw = F.when(k == 0, i.cast("string")).when(k == 1, F.concat((i % 100).cast("string"), F.lit(".5"))).when(k == 2, F.col("event_type")).otherwise("1.5x")
    num, kind = T.metric(F.col("raw"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumns({"num": num, "kind": kind})


@query("""
SELECT doc_id, sha1('blob ' || octet_length(encode(text))::VARCHAR || chr(0) || text) AS blob FROM documents""")
def blob_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that git would give each text."""
    return table(spark, sf_dir, "documents").select("doc_id", T.blob_id(F.encode("text", "UTF-8")).alias("blob"))


@query(r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents)
SELECT doc_id, line, last_value(CASE WHEN regexp_matches(body, '[!?]$') THEN left(body, 40) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS heading,
  lag(left(body, 40)) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM x WHERE trim(body) <> ''""")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last one that ends in a mark, and the one before."""
    rows = rules.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").filter(F.trim("body") != "")
    rows = rules.with_context(rows, "doc_id", r"[!?]$")
    return rows.select("doc_id", "line", F.substring("heading", 1, 40).alias("heading"), F.substring("before", 1, 40).alias("before"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_TABLE = ", ".join(f"({_quoted(r.category)}, {_quoted(r.label)}, {_quoted(r.scope)}, {_quoted(r.pattern)})" for r in mentions.TABLE)
_MENTIONS = f"""
rules(category, label, scope, pattern) AS (VALUES {_TABLE}),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line FROM documents),
c AS (SELECT *, last_value(CASE WHEN regexp_matches(body, '^#+ ') THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS heading,
  coalesce(sum(CASE WHEN regexp_matches(body, '^(?:```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) % 2 = 1, false) AS fenced,
  last_value(CASE WHEN trim(body) <> '' THEN body END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
h AS (SELECT c.*, category, label, scope, regexp_extract_all(body, pattern) AS ms, regexp_split_to_array(body, pattern) AS ps FROM c, rules WHERE regexp_matches(body, pattern)),
e AS (SELECT *, ms[nth] AS match, list_sum(list_transform(ps[1:nth], lambda y: length(y)))::INT + coalesce(list_sum(list_transform(ms[1:nth - 1], lambda y: length(y))), 0)::INT AS "offset"
  FROM (SELECT *, unnest(range(1, len(ms) + 1))::INT AS nth FROM h)),
a AS (SELECT * FROM e WHERE CASE scope WHEN 'code' THEN fenced WHEN 'prose' THEN NOT fenced WHEN 'fetched' THEN regexp_matches(body, {_quoted(mentions.FETCH)}) OR coalesce(regexp_matches(before, {_quoted(mentions.FETCH)}), false)
  WHEN 'remote' THEN NOT regexp_matches(body, {_quoted(mentions.LOCAL)}) ELSE true END),
j AS (SELECT doc_id, line, category, label, nth, match, "offset", CASE WHEN scope = 'any' THEN NULL WHEN coalesce(regexp_matches(heading, {_quoted(mentions.WARNS)}), false) THEN 'heading'
  WHEN regexp_matches(body, '^ *[|].*[|] *$') OR contains(body, ' | ') THEN 'table' WHEN scope IN ('affirmed', 'unquoted') AND len(regexp_extract_all(left(body, "offset"), {_quoted(mentions.QUOTE)})) % 2 = 1 THEN 'quoted'
  WHEN scope = 'affirmed' AND regexp_matches(regexp_extract(left(body, "offset"), '([^.,;:!?]*)$', 1), {_quoted(mentions.DENIED)}) THEN 'denied' END AS why FROM a)
"""


@query(f"WITH {_MENTIONS} SELECT * FROM j")
def rule_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of forty rules, judged at its own place."""
    return mentions.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(f"""WITH {_MENTIONS} SELECT doc_id, line, category, label, count(*) FILTER (why IS NULL) AS n, count(*) FILTER (why IS NOT NULL) AS mentions,
  left(coalesce(string_agg(match, ' | ' ORDER BY nth) FILTER (why IS NULL), ''), 120) AS match FROM j GROUP BY ALL""")
def mention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's flags and mentions, each counted apart."""
    return mentions.flagged(mentions.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id")
