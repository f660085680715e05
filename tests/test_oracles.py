"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quire.jobs import queries as Q
from quire.operators import search
from quire.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def text(v) -> str:
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float) and not isinstance(v, bool):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.oracle_sql()])
def test_has_rows(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_registered_ann_recall(spark):
    c = Corpus(spark, SF)
    q = c.table("embeddings").where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.select("query_id", "id").collect()}
    exact = pairs(search.knn(q, c.collection))
    assert len(exact & pairs(search.knn_ann(q, c.collection))) >= 0.9 * len(exact)
