import pytest

from kestrelq import plans
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
#: Rightly empty on this table.
EMPTY_OK = {"subquery_not_in", "q18_large_orders"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLE:
        assert df.count() > 0
        return
    found = difference(df, connect(SF), plans.ORACLE[name])
    assert found == "" or found == "no rows" and name in EMPTY_OK, found


def test_oracles_have_queries():
    assert set(plans.ORACLE) <= set(plans.QUERIES)
