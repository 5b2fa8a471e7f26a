"""Every query of the time-series operators runs, and equals its SQL twin where there is one."""

import pytest
from oracle import DATA, assert_same, duck

from chronolith.plans import queries as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert_same(got, duck(DATA, SQL[name]))
    else:
        assert len(got)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
