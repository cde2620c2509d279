import importlib

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 4, 5, 6)} <= set(queries)


def test_core_does_not_need_the_llm_package():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "helica"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "helica.llm" not in path.read_text(), path
    assert importlib.import_module("helica.plans.registry").QUERIES
