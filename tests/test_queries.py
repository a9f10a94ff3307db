"""Every query of the library against its SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pytest

from spoor.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())
