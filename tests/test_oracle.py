"""Every query of the core catalogue against its SQL in DuckDB; those without SQL must run and keep their schema."""

import glob
import math
import os

import duckdb
import pytest

from docmetrics import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


def near(a, b):
    return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) < 2e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert len(set(cols)) == len(cols)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(map(near, a, b)), (a, b)
