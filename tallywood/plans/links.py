"""Queries on the links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

HREF = r'(?:href|src)="([^"]*)"'


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, nth, ref): every reference of a page, in order."""
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("nth", "ref"))


_LINKS = "l AS (SELECT page_id, url, unnest(x) AS ref, generate_subscripts(x, 1) - 1 AS nth FROM (SELECT page_id, url, regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1) AS x FROM pages))"
_TARGET = "CASE WHEN regexp_matches(ref, '^[a-z]+://') THEN ref WHEN starts_with(ref, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || ref END"


def target(ref, url):
    """A reference's address; null where it is neither absolute nor from the root."""
    return F.when(ref.rlike("^[a-z]+://"), ref).when(ref.startswith("/"), F.concat(F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1), ref))


@query(f"WITH {_LINKS} SELECT page_id, nth::INT AS nth, ref, {_TARGET} AS target FROM l")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of every page with its address."""
    return links(table(spark, sf_dir, "pages")).select("page_id", "nth", "ref", target(F.col("ref"), F.col("url")).alias("target"))


@query(f"WITH {_LINKS} SELECT nullif(lower(regexp_extract({_TARGET}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(table(spark, sf_dir, "pages")).select("page_id", T.host(target(F.col("ref"), F.col("url"))).alias("host"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"WITH {_LINKS}, t AS (SELECT page_id, nth, ref, {_TARGET} AS target FROM l) SELECT page_id, nth::INT AS nth, ref, CASE WHEN target IS NULL THEN 'no address' ELSE 'no such page' END AS reason FROM t WHERE target IS NULL OR target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose address no page has."""
    pages = table(spark, sf_dir, "pages")
    rows = links(pages).select("page_id", "nth", "ref", target(F.col("ref"), F.col("url")).alias("target"))
    free = rows.join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_anti")
    return free.select("page_id", "nth", "ref", F.when(F.col("target").isNull(), "no address").otherwise("no such page").alias("reason"))
