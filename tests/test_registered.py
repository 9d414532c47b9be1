"""Every registered query with SQL equals it; every other one gives rows."""

import duckdb
import pytest

import checks
from tools.compare import TABLES, rows_of

checks.load()


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(checks.ORACLES))
def test_equals_sql(spark, con, folder, name):
    df = checks.QUERIES[name](spark, folder)
    cur = con.execute(checks.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["feature_importance", "train_compact"])
def test_gives_rows(spark, folder, name):
    assert checks.QUERIES[name](spark, folder).count() > 0
