"""Operators on small grids with values worked out by hand, and their properties."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.functions import scalars, vectors
from driftlake.operators import budget, federation, fingerprint, identity, posterior, solvers, sweep
from driftlake.plans import rounds
from driftlake.sources import files, generators


def grid_of(spark, gt, pred=None, acc=None):
    gt = np.atleast_2d(gt)
    pred = gt if pred is None else np.atleast_2d(pred)
    acc = np.ones(gt.shape) if acc is None else np.atleast_2d(acc)
    rows = [(k, t, int(gt[k, t]), int(pred[k, t]), float(acc[k, t])) for k in range(gt.shape[0]) for t in range(gt.shape[1])]
    return spark.createDataFrame(rows, "client long, t long, gt long, pred long, acc double")


def one(df):
    return df.first().asDict()


def test_alignment(spark):
    swapped = grid_of(spark, [0, 0, 1, 1], [1, 1, 0, 0])
    assert {r.pred: r.aligned for r in identity.mapping(swapped).collect()} == {1: 0, 0: 1}
    assert one(identity.overall(swapped))["re_id"] == 1.0
    extra = grid_of(spark, [[0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 0, 1]], [[0, 0, 0, 1, 1, 2], [0, 2, 1, 1, 0, 1]])
    assert {r.pred: r.aligned for r in identity.mapping(extra).collect()} == {0: 0, 1: 1, 2: -1}
    assert one(identity.overall(extra)) == {"re_id": pytest.approx(10 / 12), "wrong_reuse": pytest.approx(2 / 12), "cells": 12}


def test_one_predicted_concept(spark):
    gt = np.tile(np.arange(4), (4, 5))
    assert one(identity.overall(grid_of(spark, gt, np.zeros_like(gt))))["re_id"] == 0.25


def test_perfect_grid(spark):
    gt = np.random.default_rng(7).integers(0, 3, (3, 8))
    assert all(r.accuracy == 1.0 for r in identity.re_id_accuracy(grid_of(spark, gt)).collect())


def test_drift_points(spark):
    gt = [[int(t >= d) for t in range(8)] for d in (2, 4, 6)]
    assert sorted((r.client, r.t) for r in identity.drift_points(grid_of(spark, gt)).collect()) == [(0, 2), (1, 4), (2, 6)]
    assert identity.drift_points(grid_of(spark, np.ones((4, 10)))).count() == 0


def test_no_drift_no_dip(spark):
    assert one(budget.worst_dip(grid_of(spark, np.zeros((4, 10)), acc=np.full((4, 10), 0.85)))) == {"worst_dip": 0.0, "worst_recovery": 0}


def test_dip_and_recovery(spark):
    found = budget.dips(grid_of(spark, [0, 0, 1, 1, 1, 1], acc=[0.9, 0.8, 0.3, 0.5, 0.78, 0.9]), window=3).collect()
    assert [(r.t, round(r.dip, 6), r.recovery) for r in found] == [(2, 0.5, 2)]


def test_auc_and_score(spark):
    assert one(budget.accuracy_auc(grid_of(spark, np.zeros((3, 5)))))["auc"] == 4.0
    assert one(budget.accuracy_auc(grid_of(spark, np.zeros((2, 5)), acc=np.tile(np.linspace(0, 1, 5), (2, 1)))))["auc"] == 2.0
    rows = spark.createDataFrame([(4.0, 8.0), (4.0, 0.0), (4.0, -1.0)], "a double, b double")
    score = budget.budget_score(F.col("a"), F.col("b"))
    assert rows.where("b > 0").select(score).first()[0] == 0.5
    for least in (0.0, -1.0):
        with pytest.raises(Exception, match="above 0"):
            rows.where(F.col("b") == least).select(score).collect()
    with pytest.raises(ValueError):
        budget.model_bytes(rows, ["a"], bits=0)


def test_switch_rate_without_transitions(spark):
    assert one(identity.switch_rate(grid_of(spark, [[1]]))) == {"switch_rate": 0.0, "transitions": 0}


def test_empty_grid(spark):
    empty = grid_of(spark, [[0]]).where("t < 0")
    for f in (identity.re_id_accuracy, identity.drift_points, identity.group_metrics, identity.hard_entropy, identity.recurrence_events, budget.mean_curve):
        f(empty).collect()


def test_hungarian_is_best():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            at = solvers.assignment(cost)
            got = sum(cost[i, j] for i, j in enumerate(at) if j >= 0)
            if n <= m:
                best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            else:
                best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert got == best and len({j for j in at if j >= 0}) == min(n, m)


def test_sinkhorn_marginals():
    rng = np.random.default_rng(1)
    a, b = rng.random(4), rng.random(6)
    plan = solvers.sinkhorn(rng.random((4, 6)), a, b, rounds=2000)
    assert np.allclose(plan.sum(1), a / a.sum()) and np.allclose(plan.sum(0), b / b.sum())


def test_clustering_finds_blobs():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.05, (8, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    truth = np.repeat(range(3), 8)
    far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    for own in (solvers.kmeans(x, 3), solvers.dbscan(far, 0.6), solvers.linkage(far, "average", clusters=3), solvers.max_gap_cut(far), solvers.spectral(x, clusters=3)):
        assert len({(a, b) for a, b in zip(own, truth)}) == 3
    assert solvers.silhouette(far, truth) > 0.9


def test_wilcoxon():
    assert solvers.wilcoxon(np.arange(1.0, 7)) == (0.0, 2 / 64)
    assert solvers.wilcoxon(np.zeros(4)) == (0.0, 1.0)
    assert solvers.wasserstein(np.array([0.0, 1]), np.array([1.0, 2])) == 1.0


def test_posterior(spark):
    row = spark.createDataFrame([(0, 1, 3), (1, 1, 3), (None, 1, 3), (0, 1, 1)], "p long, c long, n long")
    got = [r[0] for r in row.select(posterior.transition_log_prior(F.col("p"), F.col("c"), F.col("n"), 0.9)).collect()]
    assert got == pytest.approx([math.log(0.05), math.log(0.9), -math.log(3), 0.0])
    losses = spark.createDataFrame([(0, 0, c, float(c)) for c in range(4)], "client long, t long, concept long, loss double")
    p = posterior.gibbs(losses, ["client", "t"]).collect()
    assert sum(r.p for r in p) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        posterior.gibbs(losses, ["client", "t"], omega=0)
    tied = losses.withColumn("loss", F.lit(1.0))
    assert one(posterior.decide(posterior.gibbs(tied, ["client", "t"]), ["client", "t"]))["concept"] == 0


def test_namespaced_aggregation(spark):
    rows = [(0, "shared.w", 0, 1.0), (0, "shared.w", 1, 2.0), (1, "shared.w", 0, 3.0), (1, "shared.w", 1, 4.0), (0, "shared.b", 0, 0.0), (1, "shared.b", 0, 2.0), (0, "expert.0.h", 0, 5.0), (1, "expert.1.h", 0, 7.0)]
    params = spark.createDataFrame([(*r, 1.0) for r in rows], "client long, name string, idx long, val double, weight double")
    weights = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "client long, concept long, p double")
    got = {(r["name"], r.idx): r.val for r in federation.aggregate_namespaced(params, weights).collect()}
    assert got == {("shared.w", 0): 2.0, ("shared.w", 1): 3.0, ("shared.b", 0): 1.0, ("expert.0.h", 0): 5.0, ("expert.1.h", 0): 7.0}


def test_fingerprint_merge_equals_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i % 3, i, [float(v) for v in rng.normal(size=3)], int(i % 2)) for i in range(40)]
    samples = spark.createDataFrame(rows, "client long, t long, row_id long, x array<double>, y long")
    whole = one(fingerprint.moments(samples, ["client"]))
    parts = one(fingerprint.merge(fingerprint.moments(samples, ["client", "t"]), ["client"]))
    assert parts["n"] == whole["n"] and np.allclose(parts["mean"], whole["mean"]) and np.allclose(parts["var"], whole["var"])
    prints = fingerprint.build(samples, ["client"], 2)
    pair = prints.select(*[F.col(c).alias(f"a_{c}") for c in prints.columns], *[F.col(c).alias(f"b_{c}") for c in prints.columns])
    assert one(fingerprint.similarity(pair))["similarity"] == pytest.approx(1.0)


def test_effective_rank(spark):
    rng = np.random.RandomState(42)
    x = rng.randn(500, 10)
    rows = spark.createDataFrame([(0, [float(v) for v in r]) for r in x], "k long, x array<double>")
    cov = np.cov(x.T)
    want = np.trace(cov) ** 2 / (cov**2).sum()
    assert one(fingerprint.effective_rank(rows, ["k"]))["effective_rank"] == pytest.approx(want)


def test_shrinkage_by_hand(spark):
    lam = spark.range(1).select(scalars.shrinkage_lambda(F.lit(1.0), F.lit(10.0), F.lit(20), F.lit(4), F.lit(200), F.lit(50)).alias("l"))
    assert one(lam)["l"] == pytest.approx(0.05 / 10.05)


def test_phase_diagram(spark):
    rows = [("a", r, 0.5, 1, v) for r, v in ((2.0, 0.6), (5.0, 0.7), (math.inf, 0.8))] + [("a", 2.0, 0.5, 0, 0.1)]
    s = spark.createDataFrame(rows, "method string, rho double, delta double, nth long, value double")
    wide = sweep.phase_diagram(s, "rho", "delta", [0.5, 0.9], "nth").orderBy("rho").collect()
    assert [r[1] for r in wide] == [0.6, 0.7, 0.8] and math.isnan(wide[0][2]) and math.isinf(wide[2][0])


def test_win_and_rank_ties(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, None)], "method string, setting long, value double")
    assert {r.method: r.win_rate for r in sweep.win_rates(s, ["setting"]).collect()} == {"a": 1.0, "b": 1.0, "c": None}
    assert {r.method: r.mean_rank for r in sweep.mean_ranks(s, ["setting"]).collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_generators(spark):
    c = generators.GeneratorConfig(clients=5, steps=8, n_samples=30, alpha=0.0)
    grid = generators.concept_grid(spark, c).collect()
    by = {}
    for r in grid:
        by.setdefault(r.client, {})[r.t] = r.gt
    assert len(grid) == 40 and len({tuple(sorted(v.items())) for v in by.values()}) == 1 and all(0 <= r.gt < c.concepts for r in grid)
    same = [generators.samples(generators.concept_grid(spark, c), c).orderBy("client", "t", "row_id").limit(20).collect() for _ in range(2)]
    assert same[0] == same[1]
    for kind in generators.KINDS:
        x, y = generators.draw(kind, 1, 50, 0.5, [1])
        assert len(x) == len(y) == 50
    with pytest.raises(ValueError):
        generators.GeneratorConfig(kind="unknown")
    balanced = generators.balance_groups(generators.concept_grid(spark, generators.GeneratorConfig(clients=9, steps=10, alpha=1.0)), 2)
    assert balanced.groupBy("t", "gt").count().where("count < 2").count() == 0


def test_every_method_runs():
    c = generators.GeneratorConfig(clients=4, steps=5, n_samples=40, rho=2.5)
    gt = np.array([[0, 0, 1, 1, 0], [0, 1, 1, 0, 0], [1, 1, 0, 0, 1], [1, 0, 0, 1, 1]])
    batches = {(i, t): generators.draw("sine", int(gt[i, t]), 40, 0.5, [1, i, t]) for i in range(4) for t in range(5)}
    for name in rounds.METHODS:
        rows = rounds.simulate_run(batches, gt, name, rounds.Options())
        assert len(rows) == 20 and all(0 <= r[4] <= 1 for r in rows)
        assert (sum(r[5] for r in rows) > 0) == (name != "LocalOnly")
    assert c.name == "sine_rho2_alpha0.50_delta0.50_seed42"


def test_log_round_trip(spark, tmp_path):
    log = {"method": "m", "ground_truth": [[0, 1]], "predicted": [[1, 1]], "accuracy_curve": [[0.5, 0.75]], "total_bytes": 9.0, "soft_assignments": [[[0.2, 0.8], [0.0, 1.0]]]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    rows = files.read_log(spark, str(tmp_path / "log.json")).orderBy("t").collect()
    assert [(r.client, r.t, r.gt, r.pred, r.acc) for r in rows] == [(0, 0, 0, 1, 0.5), (0, 1, 1, 1, 0.75)]
    assert files.read_soft(spark, str(tmp_path / "log.json")).count() == 3


def test_results_folder(spark, tmp_path):
    for i, rho in enumerate(("inf", "2.0")):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}/config.json").write_text(json.dumps({"rho": rho, "alpha": 0.5, "K": 3}))
        (tmp_path / f"run{i}/metrics.json").write_text(json.dumps({"accuracy_auc": 1.0 + i}))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/config.json").write_text("{oops")
    (tmp_path / "bad/metrics.json").write_text("{}")
    rows = {r.run: (r.rho, r.accuracy_auc) for r in files.read_results(spark, str(tmp_path)).collect()}
    assert rows == {"run0": (math.inf, 1.0), "run1": (2.0, 2.0)}


def test_dataset_csv_json_findings(spark, tmp_path):
    samples = spark.createDataFrame([(0, 0, 0, [1.0], 1), (0, 1, 0, [2.0], 0)], "client long, t long, row_id long, x array<double>, y long")
    files.write_dataset(samples, str(tmp_path / "d"))
    assert sorted(map(tuple, files.read_dataset(spark, str(tmp_path / "d")).select("client", "t", "y").collect())) == [(0, 0, 1), (0, 1, 0)]
    stats = spark.createDataFrame([("a", 0.5), ("b", None), ("c", math.inf)], "m string, v double")
    files.write_csv(stats, str(tmp_path / "c"))
    files.write_json(stats, str(tmp_path / "j"))
    back = sorted(spark.read.json(str(tmp_path / "j")).collect(), key=lambda r: r.m)
    assert [r.v for r in back] == ["0.5", None, "inf"]
    files.add_finding(spark, str(tmp_path / "f"), {"id": "1", "kind": "result", "title": "Alpha", "tags": ["x"]})
    files.add_finding(spark, str(tmp_path / "f"), {"id": "1", "kind": "note", "title": ""})
    assert files.findings(spark, str(tmp_path / "f"), tag="x").count() == 1 and files.findings(spark, str(tmp_path / "f"), text="alp").count() == 1
    refs = spark.createDataFrame([("1", "finding", "9"), ("1", "file", "a.csv")], "id string, kind string, target string")
    issues = files.audit_findings(files.findings(spark, str(tmp_path / "f")), spark.createDataFrame([("b.csv",)], "path string"), refs)
    assert sorted(r.issue for r in issues.collect()) == ["missing file", "no title", "repeated id", "unknown id"]
    assert "\\textbf{0.500" in files.latex_table(spark.createDataFrame([("a", 1, 0.5, 0.1), ("b", 1, 0.4, 0.1)], "m string, s long, mean double, std double"), "m", "s")


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], {1: 0.5, 2: 0.3, 3: 0.2, 4: 0.001})], "a array<double>, b array<double>, w map<int,double>")
    got = one(row.select(vectors.norm("a").alias("n"), vectors.cosine("a", "b").alias("c"), vectors.top_weights("w", 2).alias("t"), vectors.sharpen("w", 0.5).alias("s"), vectors.l2_normalise("a").alias("l")))
    assert got["n"] == 5.0 and got["c"] == pytest.approx(0.96) and got["l"] == [0.6, 0.8]
    assert got["t"] == {1: pytest.approx(0.625), 2: pytest.approx(0.375)} and sum(got["s"].values()) == pytest.approx(1.0)
    with pytest.raises(Exception, match="mass must be finite"):
        spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(vectors.checked_mass("a")).collect()


def points(spark, **curves):
    return spark.createDataFrame([(m, float(x), float(y)) for m, c in curves.items() for x, y in c], "method string, total_bytes double, accuracy_auc double")


def test_crossovers(spark):
    found = budget.crossovers(points(spark, a=[(0, 0), (10, 10)], b=[(0, 6), (10, 4)]), "a", "b").collect()
    assert len(found) == 1 and found[0].total_bytes == pytest.approx(5.0) and found[0].accuracy_auc == pytest.approx(5.0)
    # a grid point at which both are equal is a crossing of its own; the last one is none
    touching = points(spark, a=[(0, 1), (19, 20)], b=[(0, 1), (19, 20)])
    assert sorted(r.total_bytes for r in budget.crossovers(touching, "a", "b").collect()) == pytest.approx(list(range(19)))
    assert budget.crossovers(points(spark, a=[(0, 0), (10, 10)], b=[(20, 6), (30, 4)]), "a", "b").count() == 0
    assert budget.crossovers(points(spark, a=[(0, 0), (10, 10)], b=[(5, 6)]), "a", "b").count() == 0
    rng = np.random.default_rng(2)
    a, b = ([(x, y) for x, y in zip(np.sort(rng.random(9) * 100), rng.random(9))] for _ in range(2))
    grid = np.linspace(max(a[0][0], b[0][0]), min(a[-1][0], b[-1][0]), 90)
    va, vb = (np.interp(grid, *zip(*c)) for c in (a, b))
    d = va - vb
    cells = [i for i in range(89) if d[i] * d[i + 1] < 0]
    want = sorted(grid[i] + d[i] / (d[i] - d[i + 1]) * (grid[i + 1] - grid[i]) for i in cells)
    assert sorted(r.total_bytes for r in budget.crossovers(points(spark, a=a, b=b), "a", "b").collect()) == pytest.approx(want)


def test_pareto_in_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [(float(x), float(y)) for x, y in zip(rng.integers(0, 300, 2000), rng.integers(0, 50, 2000))]
    found = {(r.total_bytes, r.accuracy_auc) for r in budget.pareto(spark.createDataFrame(rows, "total_bytes double, accuracy_auc double")).collect()}
    assert found == {p for p in rows if not any(q[0] <= p[0] and q[1] >= p[1] and q != p for q in rows)}


def test_gates(spark):
    among = points(spark, ours=[(10, 5), (20, 9)], other=[(5, 6)], leader=[(1, 10)])
    assert one(budget.frontier_gate(among, ["ours"], ["leader"])) == {"not_beaten": 1, "best_method": "leader", "passed": True}
    assert one(budget.frontier_gate(among.where("total_bytes <> 20"), ["ours"], ["leader"]))["passed"] is False
    summary = spark.createDataFrame([("ours", 0.6), ("ours", 0.8), ("other", 0.7)], "method string, re_id double")
    assert one(budget.identity_gate(summary, "ours", "other", "re_id"))["passed"]
    assert one(budget.identity_gate(summary, "ours", "missing", "re_id"))["passed"] is False


def test_detection_metrics_by_both_definitions(spark):
    drifts = spark.createDataFrame([(0, 3), (0, 8), (1, 2)], "client long, t long")
    fired = spark.createDataFrame([(0, 4), (0, 8), (1, 2), (1, 5), (1, 6)], "client long, t long")
    got = one(identity.detection_metrics(drifts, fired))
    assert got["detection_rate"] == pytest.approx(5 / 3) and got["false_alarm_rate"] == pytest.approx(2 / 5)
    assert got["hit_rate"] == pytest.approx(2 / 3) and got["miss_share"] == pytest.approx(3 / 5)
    assert got["identification_accuracy"] == pytest.approx(2 / 5) and got["mean_delay"] == pytest.approx(1 / 3)
    none = one(identity.detection_metrics(drifts.limit(0), fired.limit(0)))
    assert none["detection_rate"] == 1.0 and none["false_alarm_rate"] == 0.0 and none["mean_delay"] == 0.0


def test_similarity_of_a_fingerprint_to_itself(spark):
    rng = np.random.default_rng(0)
    rows = [(k, 0, i, [float(v) for v in rng.normal(size=3)], i % 2) for k in range(2) for i in range(12)]
    rows += [(2, 0, r[2], r[3], r[4]) for r in rows if r[0] == 0]
    prints = fingerprint.build(spark.createDataFrame(rows, "client long, t long, row_id long, x array<double>, y long"), ["client", "t"], 2)
    pairs = fingerprint.all_pairs(prints, "client", "t")
    got = {(r.a_client, r.b_client): r.similarity for r in fingerprint.similarity(pairs).collect()}
    assert got[0, 2] == pytest.approx(1.0) and got[0, 1] < 1 and got[0, 1] == pytest.approx(got[1, 2])
    x = {k: np.array([r[3] for r in rows if r[0] == k]) for k in (0, 1)}
    var = np.maximum((x[0].var(0, ddof=1) + x[1].var(0, ddof=1)) / 2, 1e-8)
    feature = np.exp(-0.5 * ((x[0].mean(0) - x[1].mean(0)) ** 2 / var).sum())
    byclass = np.mean([np.exp(-0.5 * ((x[0][c::2].mean(0) - x[1][c::2].mean(0)) ** 2 / var).sum()) for c in (0, 1)])
    assert got[0, 1] == pytest.approx(0.25 * feature + 0.30 + 0.45 * byclass)
    grouped = {(r.a_client, r.b_client): r.similarity for r in fingerprint.similarity(pairs, groups=[(0, 2, 1.0), (2, 3, 3.0)]).collect()}
    part = lambda s: np.exp(-0.5 * ((x[0].mean(0)[s] - x[1].mean(0)[s]) ** 2 / var[s]).sum())
    both = [[np.exp(-0.5 * ((x[0][c::2].mean(0)[s] - x[1][c::2].mean(0)[s]) ** 2 / var[s]).sum()) for s in (slice(0, 2), slice(2, 3))] for c in (0, 1)]
    assert grouped[0, 1] == pytest.approx(0.25 * (0.25 * part(slice(0, 2)) + 0.75 * part(slice(2, 3))) + 0.30 + 0.45 * np.mean([0.25 * a + 0.75 * b for a, b in both]))
    with pytest.raises(ValueError):
        fingerprint.similarity(pairs, groups=[(0, 2, -1.0)])


def test_merge_of_large_means(spark):
    rows = [(0, t, i, [1e9 + (t * 7 + i) % 5], 0) for t in range(4) for i in range(5)]
    samples = spark.createDataFrame(rows, "client long, t long, row_id long, x array<double>, y long")
    merged = fingerprint.merge(fingerprint.moments(samples, ["client", "t"]), ["client"]).first()
    values = np.array([r[3][0] for r in rows])
    assert merged["var"][0] == pytest.approx(np.var(values - 1e9, ddof=1)) and merged["mean"][0] == values.mean()


def test_faded_accuracy_of_long_histories(spark):
    rng = np.random.default_rng(3)
    hits = rng.integers(0, 2, 5000)
    found = identity.running_accuracy(grid_of(spark, np.zeros(5000, int), 1 - hits), 0.9).orderBy("t").collect()
    top = mass = 0.0
    for r, h in zip(found, hits):
        top, mass = top * 0.9 + h, mass * 0.9 + 1
        assert r.accuracy == pytest.approx(top / mass, abs=1e-9)
    with pytest.raises(ValueError):
        identity.running_accuracy(grid_of(spark, [[0]]), 1.5)


def test_eigengap():
    # three near 0, one gap, then a plateau
    assert solvers.eigengap(np.array([0.0, 0.01, 0.02, 0.8, 0.9, 0.95, 0.97, 0.98, 0.985, 0.99]), 4) == 4
    assert solvers.eigengap(np.array([0.0, 0.01, 0.02, 0.9, 0.901, 0.902, 0.903, 0.904, 0.905, 0.906]), 5) == 3
    # only the first gap stands out, which is left aside: how many lie below 0.95
    assert solvers.eigengap(np.array([0.0, 0.96, 0.961, 0.962, 0.963, 0.964, 0.965, 0.966]), 4) == 1
    assert solvers.eigengap(np.array([0.0]), 4) == 1 and solvers.eigengap(np.array([0.0, 0.5, 0.9]), 3, least=2) >= 2


def test_average_link_clusters():
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [1, 1]])
    assert solvers.greedy_clusters(x, 0.8).tolist() == [0, 0, 1, 1, 2]
    # the mean similarity to all members decides, not that to their mean
    spread = np.array([[1.0, 0], [0.6, 0.8], [0.8, 0.6]])
    sims = [[solvers.cosine(a, b) for b in spread] for a in spread]
    assert solvers.greedy_clusters(spread, 0.59).tolist() == [0, 0, 0] and np.mean([sims[2][0], sims[2][1]]) == pytest.approx(0.88)


def test_permuted_labels_of_many_concepts(spark):
    rows = spark.range(12_000).select(F.col("id").alias("concept"), (F.col("id") % 4).alias("y"))
    found = generators.permute_labels(rows, "y", "concept", 4).collect()
    assert len(found) == 12_000 and all(r.y is not None and 0 <= r.y < 4 for r in found)
    assert found[0].y == 0 or min(r.y for r in found if r.concept == 0) == 0


def test_all_metrics_without_identities(spark):
    grid = grid_of(spark, [[0, 0, 1, 1], [1, 1, 0, 0]], acc=[[0.9, 0.9, 0.3, 0.9]] * 2)
    whole, bare = one(identity.all_metrics(grid, 8.0)), one(identity.all_metrics(grid, identity_capable=False))
    assert whole["re_id"] == 1.0 and whole["worst_dip"] == pytest.approx(0.6) and whole["budget_score"] == pytest.approx(whole["accuracy_auc"] / 8)
    assert bare["re_id"] is None and bare["assignment_entropy"] is None and bare["budget_score"] is None and bare["final_accuracy"] == pytest.approx(0.9)


def test_logs_diagrams_and_conditions(spark, tmp_path):
    grid = grid_of(spark, [[0, 1], [1, 0]])
    files.write_log(grid, f"{tmp_path}/log", {"method": "m", "total_bytes": 8.0, "rho": math.inf})
    assert spark.read.parquet(f"{tmp_path}/log/cells").count() == 4 and spark.read.json(f"{tmp_path}/log/about").first().rho == "inf"
    diagram = spark.createDataFrame([(1, 0.5, None)], "setting long, c0 double, c1 double")
    files.write_phase_diagram(diagram, f"{tmp_path}/phase", {"metric": "re_id", "axis": "rho"})
    cells, about = files.read_phase_diagram(spark, f"{tmp_path}/phase")
    assert cells.collect() == diagram.collect() and about == {"metric": "re_id", "axis": "rho"}
    files.write_conditions(grid, f"{tmp_path}/conditions", ["client"])
    assert sorted(p.name for p in tmp_path.joinpath("conditions").glob("client=*")) == ["client=0", "client=1"]
    rows = spark.createDataFrame([("f/1", "Title", "Body"), ("f2", "Other", "Text")], "id string, title string, body string")
    assert files.promote_findings(rows, f"{tmp_path}/notes", ["f/1"]) == 1
    assert "# Title" in next(tmp_path.joinpath("notes", "name=f-1").glob("*.txt")).read_text()


def test_fixed_rounds_the_binary_value(spark):
    """Halves go to the even digit, and 1.15 lies under its half."""
    values = [106.5, 107.5, 0.5, 1.5, -0.5, -0.2, 1.15, 1.25, 0.0005, 0.0015, 1e23, 2.0**60, float("inf"), float("-inf"), float("nan"), 0.125, 999.5, 1250.0, 1150.0, 1e6, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    for digits in (0, 1, 3):
        got = {r.i: r.s for r in rows.select("i", scalars.fixed(F.col("x"), digits).alias("s")).collect()}
        assert got == {i: None if v is None else f"%.{digits}f" % v for i, v in enumerate(values)}
    x = F.col("x")
    got = {r.x: (r.a, r.b, r.c) for r in rows.where("x in (106.5, 0.125, 1250, 1150, 1e6)").select("x", scalars.shown(x, 0).alias("a"), scalars.shown_bytes(x).alias("b"), scalars.shown_bytes(x, {"K": 1e3}).alias("c")).collect()}
    assert got[106.5] == ("106",) * 3 and got[0.125] == ("0",) * 3
    assert got[1250.0] == ("1250", "1.2K", "1.2K") and got[1150.0] == ("1150", "1.1K", "1.1K") and got[1e6] == ("1000000", "1.0M", "1000.0K")
    assert [r[0] for r in rows.where("x is null").select(scalars.shown(x)).collect()] == ["--"]


def test_formatted_cells_of_odd_values(spark, tmp_path):
    """Ties, large values, null and NaN: what the SQL gives."""
    import duckdb

    from driftlake.plans import catalog

    values = [106.5, -0.5, 1250.0, 1150.0, 9950.0, 2.5e6, float("nan"), float("inf"), None]
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = catalog.QUERIES["formatted_cells"](spark, str(tmp_path)).select("s_suppkey", "text", "size").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(catalog.SQL["formatted_cells"]).fetchall())
