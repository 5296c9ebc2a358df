import os

import pytest

from parleylake.plans import registry
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    columns, extra, missing = differences(spark, registry.QUERIES[name], registry.SQL[name])
    assert columns[0] == columns[1] and not extra and not missing


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    registry.QUERIES["page_before"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "EqualTo(msg_table" in plan and "LessThan(rowid" in plan and "member_profile" not in plan
