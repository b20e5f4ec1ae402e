"""Queries run over whole tables: rows against DuckDB with the registered SQL's own cuts taken out."""

import glob
import os

import duckdb
import numpy as np
import pytest

from driftlake.operators import identity
from driftlake.plans import catalog

EVERY_THIRD = "p.client % 3 = 0"


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(spark, duck, sf_dir, name, sql):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["gibbs_posterior", "posterior_decisions", "posterior_top_candidates", "calibrated_omega", "round_diagnostics", "nearest_slots", "soft_aggregation"])
def test_every_vector(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, name, catalog.SQL[name].replace(EVERY_THIRD, "true"))


@pytest.mark.parametrize(
    ("name", "cuts"),
    [
        ("effective_rank", {"x[1:8]": "x", "unnest(range(8))": "unnest(range(64))"}),
        ("softmax_rows", {"embedding[1:8]": "embedding"}),
        ("composed_downloads", {"WHERE client < 6": "", "SELECT unnest(range(6)) AS s": "SELECT vec_id AS s FROM embeddings"}),
    ],
)
def test_all_components_and_slots(spark, duck, sf_dir, name, cuts):
    sql = catalog.SQL[name]
    for cut, whole in cuts.items():
        sql = sql.replace(cut, whole)
    same(spark, duck, sf_dir, name, sql)


def test_least_squares_on_whole_vectors(spark, duck, sf_dir):
    rows = duck.sql("SELECT vec_id % 10, embedding FROM embeddings").fetchall()
    got = {(r.client, r.i): r.coef for r in catalog.QUERIES["least_squares"](spark, sf_dir).collect()}
    assert len(got) == 10 * 65
    for client in range(10):
        x = np.array([e for c, e in rows if c == client], float)
        # the ridge as further rows: another way than the normal equations
        a = np.vstack([np.column_stack([x, np.ones(len(x))]), np.sqrt(1e-6) * np.eye(65)])
        want = np.linalg.lstsq(a, np.concatenate([x.sum(1) * 2 + 1, np.zeros(65)]), rcond=None)[0]
        assert [got[client, i] for i in range(65)] == pytest.approx(want.tolist(), abs=1e-4)


def test_long_chains_of_merges(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 60), (70, 71)], "old long, new long")
    ids = spark.createDataFrame([(0,), (29,), (50,), (60,), (70,), (80,)], "id long")
    assert {r.id: r.root for r in identity.resolve_merges(pairs, ids).collect()} == {0: 50, 29: 50, 50: 50, 60: 60, 70: 71, 80: 80}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "old long, new long")
    with pytest.raises(ValueError, match="cycle"):
        identity.resolve_merges(ring, ids)
