import pytest

from skein.llm import queries
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLE_SQL[name]))
