"""Training-data queries that SQL can state, against DuckDB."""

import pytest

from hirescope.llm import queries as Q
from tests.test_oracle import _digest, _duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = Q.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = _duck(SF).execute(Q.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert len(rows) == len(want)
    assert _digest(rows, df.columns) == _digest(want, columns)
