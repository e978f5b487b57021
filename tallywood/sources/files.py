"""File trees as tables, and the change between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.matching import paired

#: Folders that hold no sources of one's own.
SKIPPED = ("node_modules", "vendor", "dist", "build", "target", "venv", "__pycache__")


def read_tree(spark: SparkSession, root: str, kept: DataFrame | None = None, most_bytes: int = 2 << 20, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """(path, size, text, skip_reason) of every file below root, but in skipped or dotted folders.

    kept: (path) of the files to read, where something else knows them, such as a version control's
    list. A file over most_bytes or with a NUL near its start keeps its row and loses its text.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.element_at(F.split("path", _literal(_plain(base))), -1)
    rows = files.select(tail.alias("path"), F.col("length").alias("size"), "content")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.filter(~F.exists(folders, lambda p: p.isin(*skipped) | p.startswith(".")))
    if kept is not None:
        rows = rows.join(kept.select("path").distinct(), "path", "left_semi")
    why = F.when(F.col("size") > most_bytes, "too large").when(T.is_binary(F.col("content")), "binary")
    return rows.select("path", "size", F.when(why.isNull(), T.text_of(F.col("content"))).alias("text"), why.alias("skip_reason"))


def _plain(base: str) -> str:
    """A root as it stands in file names, whatever its scheme."""
    return base.split("://", 1)[-1] if "://" in base else base.removeprefix("file:")


def _literal(text: str) -> str:
    """A pattern that matches text itself."""
    return "".join("\\" + c if c in r"\.+*?()[]{}^$|" else c for c in text)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, old_path) between two trees (path, text): added, deleted, modified or renamed.

    Texts are compared line by line, however the lines end. A deleted file and an added one of the same
    text are one rename, each used once, in the order of their paths.
    """
    norm = lambda c: F.sha2(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n", "\n"), 256)
    a, b = before.select("path", norm("text").alias("h")), after.select(F.col("path").alias("p"), norm("text").alias("g"))
    both = a.join(b, F.col("path") == F.col("p"), "full")
    gone = both.filter("p IS NULL").select(F.col("path").alias("old_path"), "h")
    came = both.filter("path IS NULL").select(F.col("p").alias("path"), F.col("g").alias("h"))
    moved = paired(gone, came, ["h"], "old_path", "path")
    out = both.filter("path = p AND h <> g").select("path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_path"))
    out = out.unionByName(moved.select("path", F.lit("renamed").alias("status"), "old_path"))
    out = out.unionByName(came.join(moved, "path", "left_anti").select("path", F.lit("added").alias("status"), F.lit(None).cast("string").alias("old_path")))
    return out.unionByName(gone.join(moved, "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("old_path")))
