import duckdb
import pandas as pd
import pytest

from doorlens.llm.queries import QUERIES, SQL
from tests.test_queries import normal

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got, want = normal(QUERIES[name](spark, FOLDER).toPandas()), normal(con.execute(SQL[name]).df())
    assert got.columns.tolist() == want.columns.tolist()
    for column in got.columns:  # the engines show missing whole numbers in two ways
        assert [None if pd.isna(v) else v for v in got[column]] == [None if pd.isna(v) else v for v in want[column]]
