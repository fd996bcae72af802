import pytest
from compare import differences, views

from wordloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_is_its_sql(spark, con, name):
    assert differences(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) is None


def test_every_query_but_the_order_dependent_has_sql():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"bigram_pruned"}


def test_entry(spark):
    df = plans.entry(spark)
    assert df.columns == ["prev", "next", "cnt", "rank", "weight"] and df.count() > 0
