"""Nested results and regression methods against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.operators import nested, regression


def plain(value, path="$"):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in plain(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in plain(v, f"{path}[{i}]")]
    return [(path, value)]


def test_flatten(spark):
    docs = [{"a": {"b": [1, 2.5, {"c": "x"}]}, "d": None}, [[1], [[2, []]], {}], 7, "text", {"deep": {"er": {"and": {"er": [0]}}}}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{bad"), (92, "")], "id long, j string")
    got = sorted((r.id, r.path, r.text) for r in nested.flatten(rows, ["id"], "j").collect())
    want = sorted((i, p, None if v is None else str(v)) for i, d in enumerate(docs) for p, v in plain(d))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert nested.flatten(rows.limit(0), ["id"], "j").count() == 0
    with pytest.raises(ValueError, match="deeper"):
        nested.flatten(spark.createDataFrame([(0, "[" * 70 + "]" * 70)], "id long, j string"), ["id"], "j")


def test_roll_up(spark):
    rows = spark.createDataFrame([("r", "$.m.a", "1"), ("r", "$.m.b[0]", "3"), ("r", "$.m.b[1]", "5"), ("r", "$.name", "x"), ("s", "$", "2")], "run string, path string, text string")
    got = {(r.run, r.node): (r.depth, r.n, r.mean, r.low, r.high) for r in nested.roll_up(rows, ["run"]).collect()}
    assert got == {
        ("r", "$"): (1, 4, 3.0, 1.0, 5.0), ("r", "$.m"): (2, 3, 3.0, 1.0, 5.0), ("r", "$.m.a"): (3, 1, 1.0, 1.0, 1.0), ("r", "$.m.b"): (3, 2, 4.0, 3.0, 5.0),
        ("r", "$.m.b[]"): (4, 2, 4.0, 3.0, 5.0), ("r", "$.name"): (2, 1, None, None, None), ("s", "$"): (1, 1, 2.0, 2.0, 2.0),
    }


def test_root_causes(spark):
    rows = [("baseline", 1, 0.8, 0.5, 10.0, None), ("baseline", 2, 0.9, 0.7, 10.0, 1.0), ("candidate", 1, 0.6, 0.3, 10.0, None), ("candidate", 2, 0.95, 0.2, 9.0, None), ("candidate", 3, 0.1, 0.2, 9.0, None)]
    runs = spark.createDataFrame(rows, "side string, seed long, final double, reuse double, bytes double, drift double")
    got = nested.root_causes(runs, "final", {"reuse": 1, "bytes": -1, "drift": -1}).orderBy("nth").collect()
    assert [(r.signal, r.verdict) for r in got] == [("reuse", "worse"), ("bytes", "better"), ("drift", "unknown")]
    assert {(r.seeds_worse, r.seeds) for r in got} == {(1, 2)} and got[0].change == pytest.approx(0.7 / 3 - 0.6)
    assert nested.root_causes(runs.where("side = 'baseline'"), "final", {"reuse": 1}).first().verdict == "unknown"


def samples_of(spark, data, concept):
    rows = [(k, t, i, x[i].tolist(), float(y[i]), int(concept[k, t])) for (k, t), (x, y) in data.items() for i in range(len(y))]
    return spark.createDataFrame(rows, "client long, t long, row_id long, x array<double>, y double, concept long")


@pytest.mark.parametrize("share", ["all", "concept", None])
def test_prequential_regression(spark, share):
    rng = np.random.default_rng(3)
    concept = np.array([[0, 0, 1, 1, 0], [0, 1, 1, 0, 0], [1, 1, 0, 0, 1]])
    lines = np.array([[1.0, -2.0], [0.5, 3.0]])
    data = {}
    for k in range(3):
        for t in range(5):
            x = rng.normal(size=(20, 2))
            data[k, t] = x, x @ lines[concept[k, t]] + 0.5 + rng.normal(size=20) * 0.1
    got = {(r.client, r.t): (r.mse, r.r2) for r in regression.prequential_regression(samples_of(spark, data, concept), 2, share).collect()}
    models, want = {}, {}
    for t in range(5):
        fits = {}
        for k in range(3):
            x, y = data[k, t]
            own = {"all": 0, "concept": concept[k, t], None: k}[share]
            e = y[:10] - np.c_[x[:10], np.ones(10)] @ models.get(own, np.zeros(3))
            want[k, t] = ((e**2).mean(), max(0.0, 1 - (e**2).mean() / y[:10].var()))
            a = np.c_[x[10:], np.ones(10)]
            fits.setdefault(own, []).append(np.linalg.solve(a.T @ a + 1e-6 * np.eye(3), a.T @ y[10:]))
        if share is None or ((t + 1) % 2 == 0 and t < 4):
            models |= {own: np.mean(f, 0) for own, f in fits.items()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_mixture_finds_planted_lines(spark):
    rng = np.random.default_rng(5)
    lines = np.array([[2.0, -1.0, 0.5], [-3.0, 0.0, 1.0], [0.0, 4.0, -2.0]])
    rows, kind = [], {}
    for c in range(40):
        kind[c] = c % 3
        for _ in range(12):
            x = rng.normal(size=2)
            rows.append((c, x.tolist(), float(x @ lines[c % 3, :2] + lines[c % 3, 2] + rng.normal() * 0.05)))
    frame = spark.createDataFrame(rows, "client long, x array<double>, y double")
    assigned, found = regression.mixture_of_regressions(frame, "client", 3)
    got = {r.client: r.line for r in assigned.collect()}
    assert len({(kind[c], line) for c, line in got.items()}) == 3 and len(got) == 40
    of = {line: kind[c] for c, line in got.items()}
    for r in found.collect():
        assert r.coef == pytest.approx(lines[of[r.line]], abs=0.05)
    assert assigned.agg(F.max("loss")).first()[0] < 0.02
    few, one = regression.mixture_of_regressions(frame.where("client = 0").withColumn("y", F.lit(2.0)), "client", 3)
    assert one.count() == 1 and few.first().loss == pytest.approx(0.0, abs=1e-9)
    assert regression.mixture_of_regressions(frame.limit(0), "client", 3)[0].count() == 0
    with pytest.raises(ValueError):
        regression.mixture_of_regressions(frame, "client", 0)
