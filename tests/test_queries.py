"""Every registered query of the core against its SQL on the smallest tables."""

import importlib

import pytest

MODULES = ["general_queries", "code_queries", "relation_queries", "catalog_queries", "component_queries", "detector_queries"]
CASES = [(m, name) for m in MODULES for name in importlib.import_module(f"lumenveil.plans.{m}").QUERIES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_matches_sql(module, name, same_as_sql, spark, data):
    m = importlib.import_module(f"lumenveil.plans.{module}")
    if name in m.SQL:
        same_as_sql(m.QUERIES[name], m.SQL[name])
    else:
        found = m.QUERIES[name](spark, data)
        assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).columns
