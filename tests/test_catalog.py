import pytest
from oracle import compare
from pondera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    compare(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = catalog.rating_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_retailprice), IsNotNull(p_size), LessThanOrEqual(p_retailprice" in plan
    assert "p_name" not in plan.split("== Physical Plan ==")[1]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
