"""Maps of capabilities as text: a derived half between markers, which is written anew, and an authored half, which isn't touched.

A map is one file and is read as a whole, so work is a row for each file. Markers that are missing or in the wrong order bound
nothing: such a half is empty when it is read, and a map without both of its derived markers is refused when it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the two halves.
DERIVED = ("<!-- DERIVED:BEGIN -->", "<!-- DERIVED:END -->")
AUTHORED = ("<!-- AUTHORED:BEGIN -->", "<!-- AUTHORED:END -->")
FACES = ("user", "dev", "unclassified")


def between(text: Column, marks: tuple[str, str]) -> Column:
    """What stands between the first of each mark; empty where one is missing or they stand the other way round."""
    begin, end = F.position(F.lit(marks[0]), text), F.position(F.lit(marks[1]), text)
    inside = F.substring(text, begin + len(marks[0]), end - begin - len(marks[0]))
    return F.when((begin > 0) & (end > begin), inside).otherwise("")


def derived_ids(maps: DataFrame) -> DataFrame:
    """(path, id): the ids in the first column of the derived half's table, each once."""
    rows = F.regexp_extract_all(between(F.coalesce("text", F.lit("")), DERIVED), F.lit(r"(?m)^\|[ \t]*`([^`\n]+)`[ \t]*\|"), F.lit(1))
    return maps.select("path", F.explode(rows).alias("id")).distinct()


def sections(half: str) -> list[tuple[str, dict[str, str]]]:
    """(id, fields) of each ``### id`` of an authored half, in order; a later section of an id takes the place of an earlier one.

    A field is a line ``- key: value``; lines that begin with a blank go on with its value, up to an empty line.
    """
    found: dict[str, dict[str, str]] = {}
    fields: dict[str, str] = {}
    key = None
    for line in half.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("###") and line[3:4] in (" ", "\t"):
            title, fields, key = line[3:].strip().strip("`"), {}, None
            kind, colon, rest = title.partition(":")
            words = rest.split() if colon and kind.lower() == "pattern" else title.split()
            if words:
                found[f"pattern:{words[0]}" if colon and kind.lower() == "pattern" else words[0]] = fields
            continue
        name, colon, value = line[1:].partition(":") if line.startswith("-") else ("", "", "")
        name = name.strip()
        if colon and name and all(c in "abcdefghijklmnopqrstuvwxyz_" for c in name):
            key, fields[name] = name, value.strip()
        elif not line.strip():
            key = None
        elif key is not None and line[0] in " \t":
            fields[key] = f"{fields[key]} {line.strip()}".strip()
    return list(found.items())


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in parts of rows rows: a map is a whole file, and what Python makes of thousands of them at once fills a worker."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def authored_entries(maps: DataFrame) -> DataFrame:
    """(path, id, fields): the authored entries of every map; fields is a map of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in few_rows(batches):
            rows = [(path, id, list(fields.items())) for path, half in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for id, fields in sections(half)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), kind), strict=True)], names=["path", "id", "fields"])

    return maps.select("path", between(F.coalesce("text", F.lit("")), AUTHORED).alias("half")).mapInArrow(run, "path string, id string, fields map<string,string>")


def snapshot(maps: DataFrame, derived: DataFrame) -> DataFrame:
    """(path, id, face, surface, code, note, grade, is_derived): derived capabilities (path, id, surface, code, note, face) and
    authored entries of each map on the same id, patterns left out.

    A face that an author wrote wins, if it is one; what only a person mapped is unclassified unless they say otherwise.
    """
    own = authored_entries(maps).filter(~F.col("id").startswith("pattern:"))
    both = derived.withColumn("is_derived", F.lit(True)).join(own, ["path", "id"], "full")
    by_hand, of = F.col("is_derived").isNull(), F.col("fields")
    said = F.lower(F.trim(F.regexp_extract(F.coalesce(of["face"], F.lit("")), r"^\s*([A-Za-z]+)\s*(?:$|[(:]|\s[-–—])", 1)))
    face = F.when(said.isin(*FACES), said).when(by_hand, "unclassified").otherwise(F.col("face"))
    pick = lambda c, hand: F.when(by_hand, hand).otherwise(F.col(c))
    return both.select(
        "path", "id", face.alias("face"), pick("surface", F.coalesce(of["surface"], F.lit(""))).alias("surface"), pick("code", F.regexp_replace(F.coalesce(of["code"], F.lit("")), "^`+|`+$", "")).alias("code"),
        pick("note", F.lit("mapped by hand")).alias("note"), F.nullif(F.upper(F.trim(F.coalesce(of["grade"], F.lit("")))), F.lit("")).alias("grade"), F.coalesce("is_derived", F.lit(False)).alias("is_derived"),
    )


def derived_tables(derived: DataFrame) -> DataFrame:
    """(path, block): the derived half of each map as a table, sorted by id; a map's capabilities stand in one file by contract."""
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.concat(F.lit("| `"), "id", F.lit("` | "), cell("face"), F.lit(" | "), cell("surface"), F.lit(" | `"), cell("code"), F.lit("` | "), cell("note"), F.lit(" |"))
    rows = derived.select("path", F.struct("id", row.alias("row")).alias("r")).groupBy("path").agg(F.array_sort(F.collect_list("r"))["row"].alias("rows"))
    return rows.select("path", F.array_join(F.concat(F.array(F.lit("| id | face | surface | code | found as |"), F.lit("|---|---|---|---|---|")), "rows"), "\n").alias("block"))


def written(maps: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, text, refused): maps with the derived half replaced by their block, in the map's own line ends, and nothing else
    changed; refused, and as they were, where a marker is missing or they stand the other way round."""
    begin, end = F.position(F.lit(DERIVED[0]), F.col("text")), F.position(F.lit(DERIVED[1]), F.col("text"))
    fits = F.coalesce((begin > 0) & (end > begin), F.lit(False))
    eol = F.when(F.col("text").contains("\r\n"), "\r\n").otherwise("\n")
    body = F.concat(F.lit("\n"), F.coalesce("block", F.lit("")), F.lit("\n"))
    new = F.concat(F.substring("text", F.lit(1), begin + len(DERIVED[0]) - 1), F.replace(body, F.lit("\n"), eol), F.substring("text", end, F.length("text")))
    return maps.join(blocks, "path", "left").select("path", F.when(fits, new).otherwise(F.col("text")).alias("text"), (~fits).alias("refused"))
