from __future__ import annotations

import pytest
from sql_compare import connect, rows

from ledgerleaf.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).sql(ORACLE_SQL[name]).df())
