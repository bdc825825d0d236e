import pytest
from compare import SF, of_frame, of_sql

import __spark_entry__ as entry
from folioq import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_equals_sql(spark, duck, name):
    got = of_frame(core.QUERIES[name](spark, SF))
    if name in core.ORACLE_SQL:
        assert got == of_sql(duck, core.ORACLE_SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    text = "SELECT $.o_orderkey AS k FROM orders WHERE $.o_totalprice >= 400000 AND $.o_orderstatus = 'F'"
    plan = core.database(spark, SF, "orders").execute(text)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,400000.0)" in plan and "EqualNullSafe(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]
