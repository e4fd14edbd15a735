import pytest
from oracle import assert_same

from tidemill.plans import file_queries, reference_queries

SF = "/root/testdata/sf0.001"
QUERIES = reference_queries.QUERIES | file_queries.QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, name):
    query, sql = QUERIES[name]
    assert_same(query(spark, SF), SF, sql)
