"""The registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with SQL of the same result if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of which a task makes files or pairs; a table of small rows comes in few splits, whatever is made of each row.
SPREAD_ROWS = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over as many tasks as their number asks for; a number that is told isn't merged again by adaptive execution."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))
    return rows.repartition(parts, key)
