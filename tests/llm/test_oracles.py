"""Every query of the subpackage that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from quire.llm import queries as Q
from tests.test_oracles import SF, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
