"""Every query of the core runs on the smallest tables and equals its SQL twin."""

import math
import os

import duckdb
import pytest

from pagemill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in catalog.oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in cols)
        want = sql.sql(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]}) AS x").fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in want)
