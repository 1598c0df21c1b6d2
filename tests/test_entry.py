import importlib

import __spark_entry__ as entry


def test_names_and_sql_agree():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_corpus_operators():
    core = importlib.import_module("corrspark.queries")
    assert not any(name.startswith("op") for name in core.QUERIES)
