"""Spectral clusters of whole groups against planted ones and the dense solver."""

import numpy as np

from driftlake.operators import spectral


def blobs(n, k, seed, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 6
    y = np.arange(n) % k
    return centres[y] + rng.normal(size=(n, d)) * 0.4, y


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_planted_groups(spark):
    rows, want = [], {}
    for g, (n, k) in enumerate(((240, 3), (90, 4))):
        x, y = blobs(n, k, g)
        rows += [(g, i, x[i].tolist()) for i in range(n)]
        want |= {(g, i): int(y[i]) for i in range(n)}
    rows.append((7, 0, [0.0] * 6))
    frame = spark.createDataFrame(rows, "g long, id long, x array<double>")
    # blocks smaller than the groups: neighbours come from several trees
    got = {(r.g, r.id): r.cluster for r in spectral.spectral_groups(frame, most=6, rounds=10, block=64).collect()}
    assert got.pop((7, 0)) == 0 and got.keys() == want.keys()
    for g in (0, 1):
        assert same_parts([c for (h, _), c in got.items() if h == g], [want[h, i] for h, i in got if h == g])


def test_neighbours_of_one_block_are_exact(spark):
    x, _ = blobs(60, 3, 5)
    near = spectral.near_rows(spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g long, id long, x array<double>"), neighbours=4, trees=2, block=100)
    d2 = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    assert {(r.a, r.b) for r in near.collect()} == {(i, int(j)) for i in range(60) for j in np.argsort(d2[i], kind="stable")[:4]}


def test_ritz_values_as_the_dense_eigenvalues(spark):
    x, _ = blobs(80, 4, 9)
    frame = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g long, id long, x array<double>")
    edges = spectral.normalised_edges(spectral.near_rows(frame, neighbours=8, trees=1, block=100))
    n = np.zeros((80, 80))
    for r in edges.collect():
        n[r.a, r.b] = r.w
    assert np.allclose(n, n.T)
    ritz, _ = spectral.ritz_rows(edges, most=5, rounds=10)
    assert ritz.select("k").distinct().collect()[0].k == 4
    v = np.array([[r[f"v{j}"] for j in range(4)] for r in ritz.orderBy("id").collect()])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6) and np.allclose(np.diag(v.T @ n @ v), np.sort(np.linalg.eigvalsh(n))[::-1][:4], atol=1e-2)


def test_no_rows(spark):
    assert spectral.spectral_groups(spark.createDataFrame([], "g long, id long, x array<double>"), rounds=1, most=2).count() == 0
