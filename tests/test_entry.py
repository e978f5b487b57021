import __spark_entry__ as E


def test_registry_and_entry(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == E.entry(spark).columns


def test_nothing_else_imports_the_llm_folder():
    from pathlib import Path

    root = Path(E.__file__).parent
    for p in root.glob("tallywood/**/*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
