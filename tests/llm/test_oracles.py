import pytest

from semaspan.llm.queries import ORACLES, QUERIES
from tools.check import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) == ""
