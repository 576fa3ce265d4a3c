import pytest
from oracle import SMALL, assert_same

from cardloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)
