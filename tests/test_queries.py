"""Every registered query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from barlake.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
#: Twins without a row on the smallest tables.
EMPTY = {"a27_equal_weight", "j8_complete_dates"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def value(v):
        if pd.isna(v):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = [tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, duck, name):
    a, b = all_queries()[name](spark, SF).toPandas(), duck.sql(all_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = plain(a), plain(b)
    assert len(x) == len(y) and (x or name in EMPTY)
    for r, s in zip(x, y):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(q))) for p, q in zip(r, s)), (r, s)
