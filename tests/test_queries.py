"""Every query that has SQL gives the rows DuckDB gives, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from driftlake.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.SQL:
        assert rows or name.endswith("detections")
        return
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
