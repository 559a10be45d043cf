"""Every registered query with SQL against DuckDB, over whole tables at the smallest scale."""

import decimal
import glob
import importlib.util
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


ENTRY = _entry()


def plain(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        return str(v.tz_convert("UTC").tz_localize(None) if v.tzinfo else v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = ENTRY.queries()[name](spark, DATA).toPandas()
    want = duck.execute(ENTRY.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(ENTRY.queries()) - set(ENTRY.oracle_sql())))
def test_runs(spark, name):
    """What has no SQL finds something in these tables; its results are tested by hand elsewhere."""
    df = ENTRY.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["id", "root", "depth", "below"] and df.count() > 0
