"""Queries on maps: one for every supplier, written from its deliveries, with sections that people wrote."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, maps
from .registry import query, table


def map_text(k: int, ids: list[str]) -> str:
    """A map whose halves, sections, fields and line ends vary with k; some have lost a marker."""
    r = random.Random(f"map {k}")
    rows = [f"| `{i}` | dev | api | `a.py:1` | route |" for i in r.sample(ids, len(ids) // 2)] + ["| no id | x |", "text `not.one` here"]
    out = ["# Map", maps.DERIVED[0], "", *rows, "", maps.DERIVED[1], "between", maps.AUTHORED[0], ""]
    for i in r.sample(ids, min(len(ids), r.randint(0, 8))) + r.sample(["ui.home", "pattern: no-direct-db now", "Pattern:short", "setting.x", "``"], r.randint(0, 4)):
        out.append(f"### {r.choice(['', '`'])}{i}{r.choice(['', ' and more words'])}")
        for _ in range(r.randint(0, 4)):
            out.append(r.choice(["- face: user", "- face: dev - not seen", "- face: everyone", "- grade: driven", "-  code : `src/x.py:3`", "- rule: first part", "- Not: a field", "plain text", "-surface: web"]))
            out += r.choice([[], ["  goes on here"], ["\tand", "  on"], ["", "  not any more"], ["* no"]])
    out += ["", maps.AUTHORED[1], "end"]
    if r.random() < 0.1:
        out.remove(r.choice([*maps.DERIVED, *maps.AUTHORED]))
    return r.choice(["\n", "\n", "\r\n"]).join(out)


def written_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(maps (path, text), derived capabilities (path, id, surface, code, note, face)): a map for every supplier."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"), "l_returnflag")
    path = F.concat(F.lit("svc"), F.col("k").cast("string"), F.lit("/MAP.md"))
    found = line.groupBy("k", "p").agg(F.min("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n"))
    id = F.concat(F.lit("endpoint.part-"), F.col("p").cast("string"))
    derived = graph.cut(found.select("k", path.alias("path"), id.alias("id"), F.when(F.col("flag") == "A", "web-ui").otherwise("api").alias("surface"), F.concat(F.lit("src/p.py:"), F.col("n").cast("string")).alias("code"), F.lit("route").alias("note"), F.when(F.col("flag") == "N", "user").otherwise("dev").alias("face")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in maps.few_rows(batches):
            texts = [map_text(k, ids) for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(texts, pa.string())], names=["path", "text"])

    named = derived.groupBy("k", "path").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return graph.cut(named.mapInArrow(run, "path string, text string")), derived.drop("k")


@query()
def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived capabilities and authored entries of every map on the same id."""
    texts, derived = written_maps(spark, sf_dir)
    return maps.snapshot(texts, derived)


@query()
def maps_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every map with its derived half written anew, read again: what it lists, and a digest of all the rest."""
    texts, derived = written_maps(spark, sf_dir)
    new = graph.cut(maps.written(texts, maps.derived_tables(derived)))
    listed = maps.derived_ids(new).groupBy("path").agg(F.count(F.lit(1)).alias("n_ids"))
    rest = F.replace(F.col("text"), maps.between(F.col("text"), maps.DERIVED), F.lit(""))
    return new.join(listed, "path", "left").select("path", "refused", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.sha2(rest, 256).alias("rest_sha256"))
