"""Every registered query with a SQL twin agrees with it; all have a stable schema."""

import decimal
import glob
import os

import duckdb
import pytest

from waygrid.plans import catalog


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v) if not isinstance(v, int) else f"{float(v):.7g}" if abs(v) < 1e6 else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    twin = con.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    places = [twin.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in twin.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
