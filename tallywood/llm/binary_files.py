"""Files of raw bytes, written by Spark's own commit protocol to any store that Spark reaches.

The text sink writes a string column's bytes as they are and ends each row with a separator, which is
any bytes once the separator's encoding is Latin-1. So a row is a block and the separator its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(df: DataFrame, column: str, end_mark: bytes, path: str, per_file: int) -> None:
    """Writes each row's bytes and end_mark; a file holds at most per_file rows, in the order of its partition."""
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", per_file)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", end_mark.decode("latin-1"))
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file that isn't empty."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
