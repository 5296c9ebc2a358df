import os

import pytest

from parleylake.llm import queries
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    columns, extra, missing = differences(spark, queries.QUERIES[name], queries.SQL[name])
    assert columns[0] == columns[1] and not extra and not missing


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
