import os

import pytest
from oracle import compare, sql_rows

from rollmill.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), sql_rows(ORACLES[name], SF)) is None
