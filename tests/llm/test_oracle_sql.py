import pytest

from oracle import both
from veilscan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got, want = both(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want
