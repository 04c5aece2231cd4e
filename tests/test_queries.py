import pytest

from bitloom.plans import registry

from . import oracle


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.rows(registry.QUERIES[name](spark, oracle.SF)) == oracle.expected(registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, oracle.SF)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
