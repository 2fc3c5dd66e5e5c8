import importlib


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_core_does_not_import_text_operators():
    import pathlib
    import re

    root = pathlib.Path(importlib.import_module("graphloom").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"graphloom\.llm|from graphloom import .*llm", p.read_text()), p
