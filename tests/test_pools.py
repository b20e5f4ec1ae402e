"""Pools, components, shrinkage, resampling, slot merges, folds and transport against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.operators import components, folds, resampling, shrinkage, slot_merges, solvers, transport
from driftlake.sources import pools


# ---------------------------------------------------------------- pools


def cells_of(spark, clients=7, steps=6, concepts=3):
    return spark.createDataFrame([(k, t, (k + t) % concepts) for k in range(clients) for t in range(steps)], "client long, t long, concept long")


def test_cells_draw_each_row_once(spark):
    pool = spark.createDataFrame([(i, i % 6) for i in range(120)], "row_id long, label long")
    counts = pools.class_counts(spark.createDataFrame([(c, y) for c in range(3) for y in (c, c + 3)], "concept long, label long"), 9)
    drawn = pools.pool_recurrence(pool, cells_of(spark), counts)
    rows = drawn.collect()
    assert len(rows) == 42 * 9 and len({(r.client, r.t, r.row_id) for r in rows}) == len(rows)
    assert all(r.row_id % 6 == r.label and r.label % 3 == r.concept == (r.client + r.t) % 3 for r in rows)
    by = drawn.groupBy("client", "t", "label").count().collect()
    assert {(r.label // 3, r["count"]) for r in by} == {(0, 5), (1, 4)}
    # an epoch gives out different rows to different cells: 20 rows of a class serve four cells of five
    used = drawn.where("label = 0").groupBy("row_id").count().agg(F.max("count"), F.min("count")).first()
    assert used[0] - used[1] <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pools.pool_recurrence(pool.repartition(5), cells_of(spark).repartition(3), counts).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, pools.pool_recurrence(pool, cells_of(spark), counts, seed=7).collect()))


def test_pool_too_small_and_empty(spark):
    pool = spark.createDataFrame([(1, 0), (2, 0)], "row_id long, label long")
    grid = spark.createDataFrame([(0, 0, 0)], "client long, t long, concept long")
    counts = spark.createDataFrame([(0, 0, 3)], "concept long, label long, n long")
    with pytest.raises(Exception, match="fewer rows"):
        pools.pool_recurrence(pool, grid, counts).collect()
    assert pools.pool_recurrence(pool, grid.limit(0), counts).count() == 0
    assert pools.pool_recurrence(pool, grid, counts.withColumn("n", F.lit(0).cast("long"))).count() == 0


def test_counts_of_clients_and_cells(spark):
    pool = spark.createDataFrame([(i, i % 2) for i in range(40)], "row_id long, label long")
    counts = spark.createDataFrame([(0, 0, 7), (0, 1, 1), (1, 1, 8)], "client long, label long, n long")
    drawn = pools.pool_recurrence(pool, cells_of(spark, clients=2, steps=3), counts)
    got = {(r.client, r.t, r.label): r["count"] for r in drawn.groupBy("client", "t", "label").count().collect()}
    assert got == {(c, t, y): n for t in range(3) for c, y, n in ((0, 0, 7), (0, 1, 1), (1, 1, 8))}
    with pytest.raises(ValueError, match="counts need"):
        pools.pool_recurrence(pool, cells_of(spark), counts.drop("client"))


def test_weighted_draw_prefers_heavy_rows(spark):
    pool = spark.createDataFrame([(i, 0, 9.0 if i < 10 else 1.0 if i < 90 else 0.0) for i in range(100)], "row_id long, label long, w double")
    grid = spark.createDataFrame([(k, 0, 0) for k in range(200)], "client long, t long, concept long")
    counts = spark.createDataFrame([(0, 0, 45)], "concept long, label long, n long")
    drawn = pools.pool_recurrence(pool, grid, counts, weight="w")
    assert drawn.where("row_id >= 90").count() == 0 and drawn.groupBy("client", "row_id").count().where("count > 1").count() == 0
    first = drawn.where("row_id < 10").count() / 10
    rest = drawn.where("row_id >= 10").count() / 80
    assert first > 1.5 * rest


def test_numbering_in_ranges(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "g long, i long")
    out = pools.numbered(rows, ["g"], pools.hash_unit("i"), ["i"], 8).groupBy("g").agg(F.sort_array(F.collect_list("nth")).alias("n"), F.count("*").alias("c")).collect()
    assert all(r.n == list(range(r.c)) for r in out)


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 7
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, g long, x array<double>")
    one = components.principal_components(rows, 3).first()
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert one.variances == pytest.approx(values) and np.array(one.loadings) @ np.array(one.loadings).T == pytest.approx(np.eye(3), abs=1e-9)
    found = np.array([r.components for r in components.project(rows, components.principal_components(rows, 3)).orderBy("id").collect()])
    assert found == pytest.approx((x - x.mean(0)) @ np.array(one.loadings).T) and found.var(0, ddof=1) == pytest.approx(values)
    by = components.project(rows, components.principal_components(rows, 2, ["g"]), ["g"])
    for g in (0, 1):
        own = np.array([r.components for r in by.where(f"g = {g}").collect()])
        assert own.var(0, ddof=1) == pytest.approx(np.linalg.eigvalsh(np.cov(x[g::2].T))[::-1][:2])
    assert components.principal_components(rows.limit(1), 2).first().variances == [0.0, 0.0]
    assert components.principal_components(rows.limit(0), 2).count() == 0


# ---------------------------------------------------------------- shrinkage


def test_shrinkage_by_its_formulas(spark):
    rng = np.random.default_rng(0)
    concept = np.array([0, 0, 0, 1, 1, 2])
    w, p = np.array([1.0, 2, 1, 3, 1, 1]), rng.normal(size=(6, 4)) + concept[:, None]
    params = spark.createDataFrame([(i, int(c), j, float(p[i, j]), float(w[i])) for i, c in enumerate(concept) for j in range(4)], "client long, concept long, idx long, val double, weight double")
    models = shrinkage.concept_models(params)
    m = np.array([np.average(p[concept == c], axis=0, weights=w[concept == c]) for c in range(3)])
    several = [i for i in range(6) if concept[i] < 2]
    sigma2 = ((p[several] - m[concept[several]]) ** 2).sum() / (5 * 4)
    between2 = max(0.0, ((m - m.mean(0)) ** 2).sum() / (2 * 4) - sigma2 / 2)
    one = shrinkage.variances(models).first()
    assert (one.concepts, one.clients_mean, one.sigma2, one.between2) == pytest.approx((3, 2.0, sigma2, between2))
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    d_eff = s.sum() ** 2 / (s**2).sum()
    assert shrinkage.effective_dimensions(models).first().d_eff == pytest.approx(d_eff)
    lam = {r.concept: r.lam for r in shrinkage.coefficients(models, shrinkage.effective_dimensions(models)).collect()}
    want = {c: sigma2 * d_eff / n / (sigma2 * d_eff / n + between2) for c, n in enumerate((3, 2, 1))}
    assert lam == pytest.approx(want)
    drawn = {(r.concept, r.idx): r.val for r in shrinkage.shrunken_models(params, models, shrinkage.coefficients(models, d_eff)).collect()}
    overall = np.average(p, axis=0, weights=w)
    assert drawn == pytest.approx({(c, j): (1 - want[c]) * m[c, j] + want[c] * overall[j] for c in range(3) for j in range(4)})
    assert {r.lam for r in shrinkage.coefficients(models, d_eff, least_snr=1e9).collect()} == {0.0}
    assert {r.lam for r in shrinkage.coefficients(models, d_eff, least_concepts=4).collect()} == {0.0}


def test_shrinkage_without_noise_or_spread(spark):
    single = spark.createDataFrame([(0, 0, 0, 1.0, 1.0), (1, 1, 0, 3.0, 1.0)], "client long, concept long, idx long, val double, weight double")
    assert shrinkage.variances(shrinkage.concept_models(single)).first().sigma2 == shrinkage.NO_NOISE
    alike = spark.createDataFrame([(i, i % 2, 0, 2.0, 1.0) for i in range(4)], "client long, concept long, idx long, val double, weight double")
    models = shrinkage.concept_models(alike)
    assert {r.lam for r in shrinkage.coefficients(models, shrinkage.effective_dimensions(models)).collect()} == {0.5}
    one = shrinkage.concept_models(single.where("concept = 0"))
    assert shrinkage.variances(one).first().between2 == 0.0 and shrinkage.effective_dimensions(one).first().d_eff == 1.0


# ---------------------------------------------------------------- resampling


def test_t_p_values():
    # Tables of Student's t
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (2.776, 4, 0.05)):
        assert resampling.t_p_value(t, df) == pytest.approx(p, abs=2e-4)
    assert resampling.t_p_value(math.inf, 3) == 0.0


def test_group_tests(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 6.0), ("c", 1.0)], "g string, v double")
    one = resampling.with_p_values(resampling.group_tests(rows, "g", "v")).collect()
    assert [(r.a, r.b, r.df) for r in one] == [("a", "b", 3)]
    pooled = (2 * np.var([1, 2, 4], ddof=1) + np.var([5, 6], ddof=1)) / 3
    assert one[0].t == pytest.approx((7 / 3 - 5.5) / math.sqrt(pooled * (1 / 3 + 1 / 2))) and one[0].f == pytest.approx(one[0].t ** 2)
    assert one[0].p == one[0].p_corrected
    still = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert resampling.with_p_values(resampling.group_tests(still, "g", "v")).first().p == 0.0


def test_bootstrap_weights_are_poisson(spark):
    rows = spark.range(2000).withColumnRenamed("id", "unit")
    all_ = resampling.replicates(rows, ["unit"], 20)
    assert all_.agg(F.sum("times")).first()[0] / 40_000 == pytest.approx(1.0, abs=0.03)
    assert all_.count() / 40_000 == pytest.approx(1 - math.exp(-1), abs=0.02)


def test_rank_stability_and_power(spark):
    rnd = random.Random(2)
    rows = [(m, u, shift + rnd.gauss(0, 1)) for u in range(60) for m, shift in (("x", 5.0), ("y", 0.0), ("z", 0.05))]
    sweep = spark.createDataFrame(rows, "method string, unit long, value double")
    got = {r.method: r for r in resampling.rank_stability(sweep, ["unit"], 80).collect()}
    assert got["x"].first == got["x"].same == 1.0 and got["x"].mean_rank == 1.0 and all(r.low <= r.mean <= r.high for r in got.values())
    assert 0 < got["y"].same <= 1 and got["y"].first == 0.0
    assert resampling.paired_power(sweep, "x", "y", ["unit"], 80).first().power == 1.0
    assert resampling.paired_power(sweep, "y", "z", ["unit"], 80).first().power < 0.9


# ---------------------------------------------------------------- slot merges


def sequential(n, edges):
    beside = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
    into = {}
    for a in range(n):
        if a not in into:
            for b in beside.get(a, []):
                into.setdefault(b, a)
    return into


@pytest.mark.parametrize("finish", [0, 40, slot_merges.FINISH])
def test_moves_equal_the_scan(spark, finish):
    rnd = random.Random(5)
    n = 1000
    ids = list(range(n))
    rnd.shuffle(ids)
    chain = list(zip(ids, ids[1:], strict=False))  # a chain in no order of ids
    star = [(ids[0], i) for i in ids[1:300]]
    edges = {(min(e), max(e)) for e in chain + star + [(rnd.randrange(n), rnd.randrange(n)) for _ in range(800)] if e[0] != e[1]}
    got = slot_merges.slot_moves(spark.createDataFrame(sorted(edges), "a long, b long"), finish)
    assert {r.id: r.into for r in got.collect()} == sequential(n, sorted(edges))


def test_ordered_chain_is_finished_by_one_task(spark):
    edges = [(i, i + 1) for i in range(2000)]
    got = {r.id: r.into for r in slot_merges.slot_moves(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i - 1 for i in range(1, 2001, 2)}


def test_merged_slots(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4))
    x = centres[rng.integers(0, 6, 80)] + rng.normal(size=(80, 4)) * 0.05
    x[40:50] = x[3]
    slots = spark.createDataFrame([(i, float(1 + i % 3), v.tolist()) for i, v in enumerate(x)] + [(80, 1.0, [0.0] * 4), (81, 0.5, x[3].tolist())], "id long, count double, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = sequential(80, [(i, j) for i in range(80) for j in range(i + 1, 80) if cos[i, j] > 0.99 or (x[i] == x[j]).all()])
    merged, moves = slot_merges.merge_slots(slots, 0.99, least_count=1.0)
    assert {r.id: r.into for r in moves.collect()} == want
    rows = {r.id: r for r in merged.collect()}
    assert set(rows) == set(range(82)) - set(want)
    assert sum(r["count"] for r in rows.values()) == pytest.approx(sum(1 + i % 3 for i in range(80)) + 1.5)
    k = min(want.values())
    own = [i for i in range(80) if want.get(i, i) == k]
    assert rows[k].vector == pytest.approx(np.average(x[own], axis=0, weights=[1 + i % 3 for i in own])) and rows[k].members == len(own)
    assert slot_merges.merge_slots(slots.limit(0), 0.9)[1].count() == 0
    with pytest.raises(ValueError):
        slot_merges.alike_slots(slots, 1.0)


@pytest.mark.parametrize("block", [1, 40, slot_merges.BLOCK])
def test_scan_by_blocks(spark, block):
    """Different slots that are mostly alike: each is compared with kept ones only, none is left for the graph of pairs."""
    rng = np.random.default_rng(8)
    x = np.eye(5)[rng.integers(0, 5, 600)] + rng.normal(size=(600, 5)) * 0.2
    ids = rng.permutation(600)
    slots = spark.createDataFrame([(int(i), 1.0, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(600, 1.0, [0.0] * 5)], "id long, count double, vector array<double>")
    u = np.zeros((600, 5))
    u[ids] = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    want = sequential(600, [(i, j) for i in range(600) for j in range(i + 1, 600) if cos[i, j] > 0.6])
    moves, rest = slot_merges.block_moves(slots.select("id", "vector"), 0.6, block)
    left = rest.count()
    assert left == 0 if block > 1 else left < 600
    assert {r.id: r.into for r in slot_merges.merge_slots(slots, 0.6, block=block)[1].collect()} == want
    assert set(r.id for r in moves.collect()) == set(want) or left


@pytest.mark.parametrize("finish", [0, slot_merges.FINISH])
def test_blocks_that_take_few_leave_the_graph(spark, finish):
    """Pairs of alike slots: a block decides itself alone, so the rest goes on as a graph."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(150, 12)), 2, axis=0) + rng.normal(size=(300, 12)) * 1e-3
    ids = rng.permutation(300)
    slots = spark.createDataFrame([(int(i), 1.0, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, count double, vector array<double>")
    assert slot_merges.block_moves(slots.select("id", "vector"), 0.999, 20)[1].count() > 200
    pairs = [(min(a, b), max(a, b)) for a, b in ids.reshape(-1, 2).tolist()]
    assert {r.id: r.into for r in slot_merges.merge_slots(slots, 0.999, finish=finish, block=20)[1].collect()} == {b: a for a, b in pairs}


# ---------------------------------------------------------------- folds and transport


def test_fold_accuracy(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 3)) + y[:, None] * 0.8
    rows = spark.createDataFrame([(i, i % 2, int(y[i]), x[i].tolist()) for i in range(90)] + [(200, 5, 0, [0.0] * 3)], "id long, c long, y long, x array<double>")
    right = {0: [], 1: []}
    for i in range(90):
        others = {k: [j for j in range(90) if j % 2 == i % 2 and j % 5 != i % 5 and y[j] == k] for k in range(3)}
        right[i % 2].append(y[i] == min((k for k in others if others[k]), key=lambda k: (((x[others[k]].mean(0) - x[i]) ** 2).sum(), k)))
    got = {r.c: (r.n, r.accuracy) for r in folds.nearest_centroid_accuracy(rows, "c", "y", "id").collect()}
    assert got[0] == pytest.approx((45, np.mean(right[0]))) and got[1] == pytest.approx((45, np.mean(right[1]))) and got[5] == (1, 0.0)


def test_transport_as_the_dense_solver(spark):
    rng = np.random.default_rng(6)
    cost = rng.random((4, 6))
    a, b = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(6))
    table = spark.createDataFrame([("k", i, j, float(cost[i, j]), float(a[i]), float(b[j])) for i in range(4) for j in range(6)] + [("k", 9, 9, 1.0, 0.0, 0.0)], "key string, i long, j long, cost double, a double, b double")
    plan = {(r.i, r.j): r.mass for r in transport.scaled_plan(table, ["key"], 0.2, 40).collect()}
    want = solvers.sinkhorn(cost, a, b, reg=0.2, rounds=2000)
    assert plan == pytest.approx({(i, j): want[i, j] for i in range(4) for j in range(6)}, abs=1e-5)
    assert transport.transport_costs(table, ["key"], 0.2, 40).first().cost == pytest.approx((want * cost).sum(), abs=1e-4)


# ---------------------------------------------------------------- methods and losses


def test_deduped_methods(spark):
    from driftlake.functions import scalars

    rows = spark.createDataFrame([(i, m) for i, m in enumerate(["FeSEM", "FedAvg", "IFCA", "Own-a", "Own-b", "FedAvg"])], "at long, method string")
    got = [r.method for r in scalars.deduped_methods(rows, "method", "at", {"FeSEM": "IFCA"}, ("Own",)).orderBy("at").collect()]
    assert got == ["FedAvg", "IFCA", "Own-a"]
    alone = scalars.deduped_methods(rows.where("method <> 'IFCA'"), "method", "at", {"FeSEM": "IFCA"}, ("Own",))
    assert [r.method for r in alone.orderBy("at").collect()] == ["FeSEM", "FedAvg", "Own-a"]


def test_faded_sums_over_several_blocks(spark):
    from driftlake.operators import fingerprint

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 2500))
    rows = spark.createDataFrame([(c, i + 1, float(x[c, i])) for c in range(2) for i in range(2500 if c else 40)], "c long, nth long, x double")
    for decay in (0.6, 0.999, 1e-3):
        got = {(r.c, r.nth): r.y for r in fingerprint.faded_sums(rows, ["c"], "nth", F.col("x"), decay, "y").collect()}
        for c, n in ((0, 40), (1, 2500)):
            y = 0.0
            for i in range(n):
                y = y * decay + x[c, i]
                assert got[c, i + 1] == pytest.approx(y, abs=1e-9)
    with pytest.raises(ValueError):
        fingerprint.faded_sums(rows, ["c"], "nth", F.col("x"), 1.0, "y")


def test_fitted_shrinkage_counts_clients(spark):
    """Seven clients of five concepts: the mean number times the concepts is just under seven; clients of two concepts count once."""
    rows = [(c, c % 5, 1.0, i, float((c * 7 + i * 3) % 11)) for c in range(7) for i in range(3)]
    schema = "client long, concept long, weight double, idx long, val double"
    one = shrinkage.fitted(spark.createDataFrame(rows, schema), 0.5, 20, 2.0).first()
    assert (one.clients, one.concepts, one.dimensions) == (7, 5, 3)
    again = [(0, 1, 1.0, i, 2.0) for i in range(3)]
    assert shrinkage.fitted(spark.createDataFrame(rows + again, schema), 0.5, 20, 2.0).first().clients == 7
