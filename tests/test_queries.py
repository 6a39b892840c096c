"""Every query with a SQL form must give the same rows in both engines."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from doorlens.plans.catalog import CHECKS, QUERIES

SMALL = "/root/testdata/sf0.001"


def connect(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


@pytest.mark.parametrize("name", list(CHECKS))
def test_matches_sql(spark, name):
    got = normal(QUERIES[name](spark, SMALL).toPandas())
    want = normal(connect(SMALL).execute(CHECKS[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
