import pytest

import __spark_entry__
from conftest import SF
from oracle import connect, rows_of, sql_rows

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(duck, ORACLES[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_merge_plan_has_one_exchange_for_both_windows(spark):
    from letterloom.queries import conversations

    plan = conversations(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    executed = conversations(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1, plan
