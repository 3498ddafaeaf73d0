"""Every core query with SQL gives the same rows as DuckDB."""

import pytest

from codeloom.plans import registry
from tests.conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(duck.sql(registry.SQL[name]).columns)
    assert rows_of(df) == rows_of_sql(duck, registry.SQL[name])


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        rows = registry.QUERIES[name](spark, sf)
        # These read files of kinds that the tables do not have; what they do is tested on fixtures.
        assert rows.count() > 0 or name in ("js_import_edges", "layer_violations", "symbol_relations", "compose_services", "manifest_parse", "import_edges", "call_impact", "docker_stages", "function_references"), name
        assert len(set(rows.columns)) == len(rows.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
