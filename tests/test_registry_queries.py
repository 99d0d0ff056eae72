"""Every query of the registry on the driver's tables, against SQL where there is some."""

import compare
import pytest

from lexiforge.plans import registry, sources  # noqa: F401  sources adds its queries


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_are_those_of_sql(spark, sf_dir, name):
    compare.check(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_the_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
