import pytest

from riskweave.llm.queries import ORACLE, QUERIES
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE[name])
