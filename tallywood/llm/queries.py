"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, lang_id, licenses, line_dedup, mixing, periods, phrases, quality, simhash, token_store, warc
from .common import let

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.bpe_encode(docs, path, pattern).drop("text")
    back = bpe.bpe_decode(ids, path)
    return back.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text less the runs of lines of 50 words or more that stand at an earlier place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_words=50)


ORACLE_SQL["op2_line_dedup"] = r"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
), worded AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s,
         sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM worded
), forward AS (
  SELECT a.doc_id, a.s, min(b.s) AS e FROM seq a JOIN seq b
    ON a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 49 AND b.upto - a.upto + a.w >= 50
  GROUP BY a.doc_id, a.s
), backward AS (
  SELECT b.doc_id, max(a.s) AS s, b.s AS e FROM seq a JOIN seq b
    ON a.doc_id = b.doc_id AND a.s BETWEEN b.s - 49 AND b.s AND b.upto - a.upto + a.w >= 50
  GROUP BY b.doc_id, b.s
), windows AS (
  SELECT * FROM forward UNION SELECT * FROM backward
), filled AS (
  SELECT v.doc_id, v.s, v.e, string_agg(q.line, chr(10) ORDER BY q.s) AS content
  FROM windows v JOIN seq q ON v.doc_id = q.doc_id AND q.s BETWEEN v.s AND v.e
  GROUP BY v.doc_id, v.s, v.e
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS nth FROM filled
), gone AS (
  SELECT DISTINCT q.doc_id, q.i FROM placed p JOIN seq q ON p.doc_id = q.doc_id AND q.s BETWEEN p.s AND p.e
  WHERE p.nth > 1
)
SELECT p.doc_id,
       coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS text,
       count(*) AS n_lines, count(g.i) AS n_deleted
FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
GROUP BY p.doc_id
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text: links at four or fewer differing bits."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), max_distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written in rANS blocks and read back."""
    read = token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's counts and verdict by the table of thresholds."""
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


ORACLE_SQL["op3_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '!')) AS bangs,
         len(list_filter(w, lambda x: list_contains(string_split('STOPS', ' '), lower(rtrim(x, '.,;:!?'))))) AS stops,
         l.n_lines, l.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / n_words::DOUBLE BETWEEN 2 AND 12 AND n_symbols / n_words::DOUBLE <= 0.1
         AND bangs / n_words::DOUBLE <= 0.2 AND stops / n_words::DOUBLE >= 0.05
         AND n_dup_lines / n_lines::DOUBLE <= 0.4 AS kept
FROM counted
""".replace("STOPS", " ".join(quality.STOP_WORDS))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written in seekable bundles and read back."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target")


ORACLE_SQL["op7_warc"] = """
WITH p AS (
  SELECT page_id, url AS target, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), first AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to, target
FROM first
"""


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language by a network learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that match: score, verified shares and place."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"), "first_word")


def _placed(docs: DataFrame) -> DataFrame:
    """Documents as files: short ones are license files of source/language, others lie in numbered folders below."""
    folder = F.concat_ws("/", "source", "lang")
    name = F.when(F.length("text") < 1000, F.concat_ws("/", folder, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))))
    return docs.select("doc_id", "text", name.otherwise(F.concat_ws("/", folder, F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license: its own by cosine, or that of the nearest folder above."""
    found = licenses.scan(_placed(table(spark, sf_dir, "documents")).select("doc_id", "path", "text"))
    return found.select("doc_id", "path", "own_license", "cosine", "license", "inherited_from")


def _license_sql() -> str:
    """The texts of the templates are all that the SQL has of the operator; it weighs them itself."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    given = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))
    stop, term = ", ".join(map(quoted, licenses.STOP)), licenses.TERM
    return rf"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN length(text) < 1000 THEN source || '/' || lang || '/LICENSE-' || doc_id
         ELSE source || '/' || lang || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents
), templates(template, license, body) AS (VALUES {given}),
counted AS (
  SELECT template, license, term, count(*) AS f FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{term}')) AS term FROM templates)
  WHERE term NOT IN ({stop}) GROUP BY ALL
), n AS (SELECT count(*) AS n FROM templates), known AS (
  SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM counted GROUP BY term
), vectors AS (
  SELECT template, license, term, f * idf / sqrt(sum((f * idf) * (f * idf)) OVER (PARTITION BY template)) AS w FROM counted JOIN known USING (term)
), lines AS (
  SELECT DISTINCT path, line, whole FROM (
    SELECT path, unnest(string_split(lower(text), chr(10)) || regexp_split_to_array(lower(text), '\n[ \t\r]*\n')) AS line, true AS whole FROM files
    UNION ALL SELECT path, unnest(regexp_split_to_array(x, '[.;][ \t]+')), false FROM (SELECT path, unnest(string_split(lower(text), chr(10))) AS x FROM files))
), tf AS (
  SELECT path, line, whole, term, count(*) AS f FROM (SELECT path, line, whole, unnest(regexp_extract_all(line, '{term}')) AS term FROM lines)
  WHERE term NOT IN ({stop}) GROUP BY ALL
), weighed AS (
  SELECT tf.*, f * coalesce(idf, ln((1 + (SELECT n FROM n))::DOUBLE) + 1) AS x FROM tf LEFT JOIN known USING (term)
), sizes AS (SELECT path, line, whole, sqrt(sum(x * x)) AS size FROM weighed GROUP BY ALL
), dots AS (SELECT path, line, whole, template, license, sum(x * w) AS dot FROM weighed JOIN vectors USING (term) GROUP BY ALL
), cosines AS (
  SELECT path, line, whole, license, max(round(dot / size, 4)) AS cosine FROM dots JOIN sizes USING (path, line, whole) WHERE round(dot / size, 4) >= 0.6 GROUP BY ALL
), said AS (SELECT * FROM cosines QUALIFY cosine = max(cosine) OVER (PARTITION BY path, line, whole)
), scored AS (SELECT path, license, round(sum(CASE WHEN whole THEN cosine ELSE 0 END), 4) AS score, round(sum(CASE WHEN whole THEN 0 ELSE cosine END), 4) AS more, max(cosine) AS cosine FROM said GROUP BY ALL
), own AS (
  SELECT path, license, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY license = 'proprietary', score DESC, more DESC, license) = 1
), spoken AS (
  SELECT dir, license FROM (
    SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, count(*) AS n FROM own WHERE regexp_matches(path, '/LICENSE[^/]*$') GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) = 1
), placed AS (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM files
), nearest AS (
  SELECT p.path, s.dir, s.license FROM placed p JOIN spoken s ON p.dir = s.dir OR starts_with(p.dir, s.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(s.dir) DESC) = 1
)
SELECT p.doc_id, p.path, o.license AS own_license, o.cosine, coalesce(o.license, n.license) AS license,
       CASE WHEN o.license IS NULL THEN n.dir END AS inherited_from
FROM placed p LEFT JOIN own o USING (path) LEFT JOIN nearest n USING (path)
"""


ORACLE_SQL["op10_license_scan"] = _license_sql()


def _with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; with h = crc32(doc_id), g = h div 10 and h % 10 = 0, a text's words from a = g % n on repeat p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, again)).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's periodic runs: the number, the longest, and digests of all and of the text less its repeats."""
    found = periods.periodic_runs(_with_repeats(table(spark, sf_dir, "documents")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in a mix of all sources, by weights 3, 1, 2 in turn, 150 % of all words long."""
    found = mixing.amounts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op13_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('13:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT *, [3, 1, 2][(nth - 1) % 3 + 1] AS w FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source)
), total AS (SELECT sum(source_size) AS n, sum(w) AS w FROM s
), filling AS (
  SELECT row_number() OVER o AS k, 2 * source_size / s.w::DOUBLE AS full, 1.5::DOUBLE * n - sum(2 * source_size) OVER o AS rest, total.w - sum(s.w) OVER o AS left_w
  FROM s, total WINDOW o AS (ORDER BY 2 * source_size / s.w::DOUBLE, nth ROWS UNBOUNDED PRECEDING)
), steps AS (
  SELECT 0 AS k, 1.5::DOUBLE * n AS rest, w AS left_w FROM total UNION ALL SELECT k, rest, left_w FROM filling
), level AS (
  SELECT a.rest, a.left_w FROM steps a LEFT JOIN filling b ON b.k = a.k + 1 WHERE b.k IS NULL OR b.full >= a.rest / a.left_w ORDER BY a.k LIMIT 1
), t AS (
  SELECT s.*, CASE WHEN left_w = 0 THEN 2.0 * source_size ELSE least(2.0::DOUBLE * source_size, rest::DOUBLE * w / left_w::DOUBLE) END::DOUBLE AS target FROM s, level
), lined AS (
  SELECT d.doc_id, d.size, d.h, t.source_size, t.target, t.nth, t.w, sum(d.size) OVER (PARTITION BY t.nth ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, unnest([0, 1]) AS copy FROM lined
), mixed AS (
  SELECT *, sum(size) OVER (ORDER BY (done + copy * source_size) / w::DOUBLE, nth, copy, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN upto <= floor(1.5 * (SELECT n FROM total)) THEN size ELSE 0 END)::BIGINT AS taken
FROM mixed GROUP BY doc_id, size, source_size, target
"""


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's first 2,000 phrases of 2 to 5 words by their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, share=100, top=2000)


ORACLE_SQL["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 6) AS t(size)) GROUP BY ALL HAVING count(*) >= 100
), found AS (SELECT lang, size, phrase, f AS a FROM grams WHERE size > 1
), own AS (
  SELECT * FROM found x WHERE NOT EXISTS (
    SELECT 1 FROM found y WHERE y.lang = x.lang AND y.size > x.size AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM own)
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * a::HUGEINT * t.n) // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.first JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM best)
SELECT * FROM placed WHERE rank <= 2000
"""
