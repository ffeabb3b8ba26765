"""Every registered query at the smallest scale, against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def normal(df):
    columns = sorted(df.columns)
    out = pd.DataFrame({
        c: df[c].map(lambda v: v if isinstance(v, (str, bool)) else (None if pd.isna(v) else float(v))) for c in columns
    })
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    expected = duck.execute(entry_point.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(expected), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    df = entry_point.queries()[name](spark, FOLDER)
    assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
