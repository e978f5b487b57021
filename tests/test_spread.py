"""Files made of small rows are made by many tasks, once, whatever reads them."""

import pytest
from pyspark.sql import functions as F

from tallywood.plans import registry, source_trees

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [source_trees.tree, lambda s, d: source_trees.checks(s, d, "base")])
def test_made_files_come_from_many_tasks_once(spark, monkeypatch, made):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 10)
    files = made(spark, SF)
    assert len([f for f in files.inputFiles() if f.endswith(".parquet")]) > 12
    assert "MapInArrow" not in files._jdf.queryExecution().executedPlan().toString()


def test_spread_is_not_merged_again(spark, monkeypatch):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 10)
    rows = registry.spread(spark.range(400).coalesce(1), "id")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 30 and rows.count() == 400


def test_folder_copies_are_paired_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 10)
    found = registry.QUERIES["folder_copies"](spark, SF)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_script_edges_tasks_follow_the_files(spark, monkeypatch):
    from tallywood.operators import code

    monkeypatch.setattr(code, "FILES_A_TASK", 10)
    files = [(f"web/a{i}.js", f"import x from './b{i}';\nimport x from './b{i}'; import('./b{i}')\nexport * from '../../out';") for i in range(150)]
    files += [(f"web/b{i}{e}", "") for i in range(150) for e in ((".js", ".ts") if i % 2 else ("/index.ts",))]
    df = spark.createDataFrame(files, "path string, text string")
    found = code.script_edges(df)
    want = {(f"web/a{i}.js", f"web/b{i}.ts" if i % 2 else f"web/b{i}/index.ts", k, n) for i in range(150) for k, n in (("import", 1), ("import", 2), ("dynamic-import", 2))}
    want |= {(f"web/a{i}.js", None, "reexport", 3) for i in range(150)}
    got = found.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert found.rdd.getNumPartitions() >= len(files) // 10
