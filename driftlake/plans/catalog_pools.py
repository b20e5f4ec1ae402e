"""Queries of feature pools, components, shrinkage, resampling, slot merges, folds and transport; registered on import by the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.functions.hashing import poisson_sql, unit_sql
from driftlake.operators import components, folds, resampling, shrinkage, slot_merges, transport
from driftlake.operators.sweep import paired_test
from driftlake.plans.catalog import register, rounded
from driftlake.sources import pools
from driftlake.sources.views import GRID_SQL, PARAMS_SQL, SAMPLES_SQL, SWEEP_SQL, event_grid, order_sweep, table, vector_params, vector_samples

# ---------------------------------------------------------------- recurrence from a pool

#: Concept c of the grid is made of the labels c and c + 5; a cell draws 3 to 6 rows of each.
POOL_SQL = f"""
WITH {GRID_SQL}, counts AS (
  SELECT label % 5 AS concept, label, CAST(3 + label % 4 AS BIGINT) AS n FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings)
), wanted AS (
  SELECT client, t, gt AS concept, label, n FROM grid JOIN counts ON concept = gt
), serves AS (
  SELECT label, max(n) AS most, size // max(n) AS slots, CAST(ceil(count(*) / (size // max(n))) AS BIGINT) AS epochs
  FROM wanted JOIN (SELECT CAST(label AS BIGINT) AS label, count(*) AS size FROM embeddings GROUP BY 1) USING (label) GROUP BY label, size
), cells AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {unit_sql("'42|' || client || '|' || t")}, client, t) - 1 AS nth FROM wanted
), places AS (
  SELECT client, t, concept, label, nth // slots AS epoch, nth % slots * most + unnest(range(n)) AS nth FROM cells JOIN serves USING (label)
), ordered AS (
  SELECT label, epoch, row_id, row_number() OVER (PARTITION BY label, epoch ORDER BY {unit_sql("'42|' || epoch || '|' || row_id")}, row_id) - 1 AS nth
  FROM (SELECT CAST(e.label AS BIGINT) AS label, vec_id AS row_id, unnest(range(epochs)) AS epoch FROM embeddings e JOIN serves s ON s.label = e.label)
)
SELECT client, t, concept, label, row_id FROM places JOIN ordered USING (label, epoch, nth)
"""


@register("pool_recurrence", POOL_SQL)
def pool_recurrence(spark, sf):
    """Vectors as the pool, the grid of events as concepts: each cell's rows."""
    pool = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"))
    label = F.col("label")
    counts = pool.select("label").distinct().select((label % 5).alias("concept"), "label", (3 + label % 4).alias("n"))
    return pools.pool_recurrence(pool, event_grid(spark, sf).select("client", "t", F.col("gt").alias("concept")), counts)


@register("pool_class_counts", "WITH c AS (SELECT c_nationkey AS concept, c_mktsegment AS label FROM customer GROUP BY ALL) SELECT concept, label, 37 // count(*) OVER (PARTITION BY concept) + CASE WHEN row_number() OVER (PARTITION BY concept ORDER BY label) <= 37 % count(*) OVER (PARTITION BY concept) THEN 1 ELSE 0 END AS n FROM c")
def pool_class_counts(spark, sf):
    return pools.class_counts(table(spark, sf, "customer").select(F.col("c_nationkey").alias("concept"), F.col("c_mktsegment").alias("label")).distinct(), 37)


# ---------------------------------------------------------------- components


def doubles(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@register(
    "component_spectrum",
    """WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.v, b.v) AS c FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT (SELECT count(*) FROM embeddings) AS n, round(sum(c) FILTER (WHERE i = j), 6) AS variance, round(sum(c * c), 6) AS squares, CAST(0 AS DOUBLE) AS skew FROM c""",
)
def component_spectrum(spark, sf):
    """All components: the projected columns have the total variance and squared covariance of the vectors, and are uncorrelated."""
    rows = doubles(spark, sf)
    found = components.project(rows, components.principal_components(rows, 64))
    long = found.select("vec_id", F.posexplode("components").alias("i", "v"))
    own = long.groupBy("i").agg(F.count("*").alias("n"), F.var_samp("v").alias("s"))
    a, b = long.select("vec_id", F.col("i").alias("a"), F.col("v").alias("x")), long.select("vec_id", F.col("i").alias("b"), F.col("v").alias("y"))
    skew = a.join(b, "vec_id").where("a < b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c")).agg(F.max(F.abs("c")).alias("skew"))
    one = own.agg(F.max("n").alias("n"), F.sum("s").alias("variance"), F.sum(F.col("s") * F.col("s")).alias("squares"))
    return rounded(one.crossJoin(skew).select("n", "variance", "squares", "skew"))


@register("projected_components")
def projected_components(spark, sf):
    """The first eight components of every vector, over all vectors."""
    rows = doubles(spark, sf)
    found = components.project(rows, components.principal_components(rows, 8))
    return rounded(found.select("vec_id", F.posexplode("components").alias("component", "value")))


# ---------------------------------------------------------------- shrinkage

#: sigma2 and between2 of the concepts' weighted models.
SHRINKAGE_SQL = f"""
WITH {PARAMS_SQL}, m AS (
  SELECT concept, idx, sum(weight * val) / sum(weight) AS val, count(*) AS clients FROM params GROUP BY 1, 2
), own AS (
  SELECT sum(power(p.val - m.val, 2)) / count(*) AS sigma2 FROM params p JOIN m USING (concept, idx) WHERE clients >= 2
), g AS (
  SELECT idx, avg(val) AS g FROM m GROUP BY idx
), spread AS (
  SELECT sum(power(val - g, 2)) / ((count(DISTINCT concept) - 1) * count(DISTINCT idx)) AS s, avg(clients) AS n FROM m JOIN g USING (idx)
), v AS (
  SELECT coalesce(sigma2, 1e-4) AS sigma2, greatest(0.0, s - coalesce(sigma2, 1e-4) / n) AS between2 FROM own, spread
)"""


@register("between_variance", SHRINKAGE_SQL + " SELECT round(sigma2, 9) AS sigma2, round(between2, 9) AS between2 FROM v")
def between_variance(spark, sf):
    return rounded(shrinkage.variances(shrinkage.concept_models(vector_params(spark, sf))).select("sigma2", "between2"), 9)


@register(
    "concept_coefficients",
    SHRINKAGE_SQL + ", k AS (SELECT concept, max(clients) AS clients FROM m GROUP BY 1) SELECT concept, clients, round(sigma2 * 12 / clients / (sigma2 * 12 / clients + between2), 6) AS lam FROM k, v",
)
def concept_coefficients(spark, sf):
    return rounded(shrinkage.coefficients(shrinkage.concept_models(vector_params(spark, sf)), 12.0).select("concept", "clients", "lam"))


@register(
    "shrunken_concepts",
    SHRINKAGE_SQL
    + """, o AS (SELECT idx, sum(weight * val) / sum(weight) AS o FROM params GROUP BY idx), l AS (SELECT concept, idx, val, sigma2 * 12 / clients / (sigma2 * 12 / clients + between2) AS lam FROM m, v)
SELECT concept, idx, round((1 - lam) * val + lam * o, 6) AS val FROM l JOIN o USING (idx)""",
)
def shrunken_concepts(spark, sf):
    params = vector_params(spark, sf)
    models = shrinkage.concept_models(params)
    return rounded(shrinkage.shrunken_models(params, models, shrinkage.coefficients(models, 12.0)))


@register(
    "concept_products",
    f"""WITH {PARAMS_SQL}, m AS (SELECT concept, idx, sum(weight * val) / sum(weight) AS val FROM params GROUP BY 1, 2), c AS (SELECT concept, idx, val - avg(val) OVER (PARTITION BY idx) AS v FROM m)
SELECT x.concept AS a, y.concept AS b, round(sum(x.v * y.v), 6) AS dot FROM c x JOIN c y ON x.idx = y.idx AND x.concept <= y.concept GROUP BY 1, 2""",
)
def concept_products(spark, sf):
    return rounded(shrinkage.concept_products(shrinkage.concept_models(vector_params(spark, sf))))


@register("effective_dimensions")
def effective_dimensions(spark, sf):
    return rounded(shrinkage.effective_dimensions(shrinkage.concept_models(vector_params(spark, sf))))


# ---------------------------------------------------------------- resampling

UNITS = ["axis", "setting", "seed"]
UNIT_TEXT = "'42|' || replicate || '|' || axis || '|' || setting || '|' || seed"
TIMES_SQL = poisson_sql("u")


@register(
    "rank_stability",
    f"""WITH {SWEEP_SQL}, whole AS (SELECT method, avg(value) AS mean, rank() OVER (ORDER BY avg(value) DESC) AS rank FROM sweep GROUP BY method),
r AS (SELECT method, replicate, value, {unit_sql(UNIT_TEXT)} AS u FROM (SELECT *, unnest(range(100)) AS replicate FROM sweep)),
m AS (SELECT method, replicate, sum({TIMES_SQL} * value) / sum({TIMES_SQL}) AS m FROM r GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY m DESC) AS r FROM m)
SELECT method, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, rank, round(avg(r), 6) AS mean_rank,
  round(avg(CAST(r = 1 AS DOUBLE)), 6) AS first, round(avg(CAST(r = rank AS DOUBLE)), 6) AS same FROM k JOIN whole USING (method) GROUP BY method, mean, rank""",
)
def rank_stability(spark, sf):
    return rounded(resampling.rank_stability(order_sweep(spark, sf), UNITS, 100))


@register(
    "paired_power",
    f"""WITH {SWEEP_SQL}, d AS (SELECT axis, setting, seed, max(value) FILTER (WHERE method = 'AF') - max(value) FILTER (WHERE method = 'RF') AS d FROM sweep GROUP BY ALL HAVING count(*) FILTER (WHERE method = 'AF') > 0 AND count(*) FILTER (WHERE method = 'RF') > 0),
r AS (SELECT replicate, d, {TIMES_SQL} AS w FROM (SELECT *, {unit_sql(UNIT_TEXT)} AS u FROM (SELECT *, unnest(range(100)) AS replicate FROM d))),
s AS (SELECT replicate, sum(w) AS k, sum(w * d) AS s, sum(w * d * d) AS q FROM r GROUP BY replicate HAVING sum(w) > 0), t AS (SELECT s / k AS m, k, (q - k * power(s / k, 2)) / (k - 1) AS v FROM s)
SELECT (SELECT count(*) FROM d) AS pairs, (SELECT round(avg(d), 6) FROM d) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
  round(avg(CAST(coalesce(CASE WHEN k > 1 AND v > 0 THEN abs(m / sqrt(v / k)) > 1.96 END, false) AS DOUBLE)), 6) AS power FROM t""",
)
def paired_power(spark, sf):
    return rounded(resampling.paired_power(order_sweep(spark, sf), "AF", "RF", UNITS, 100))


GROUPS_SQL = f"""WITH {SWEEP_SQL}, g AS (SELECT axis AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM sweep GROUP BY axis HAVING count(*) > 1),
f AS (SELECT ((sum(n * m * m) - power(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(v * (n - 1)) / (sum(n) - count(*))) AS f FROM g),
p AS (SELECT a.g AS a, b.g AS b, a.m - b.m AS diff, a.n + b.n - 2 AS df, (a.v * (a.n - 1) + b.v * (b.n - 1)) / (a.n + b.n - 2) AS pooled, 1 / a.n + 1 / b.n AS w FROM g a JOIN g b ON a.g < b.g)"""


@register("group_tests", GROUPS_SQL + " SELECT a, b, round(diff, 6) AS diff, round(abs(diff) / sqrt(pooled), 6) AS cohen_d, round(diff / sqrt(pooled * w), 6) AS t, df, round(f, 4) AS f FROM p, f")
def group_tests(spark, sf):
    tests = resampling.group_tests(order_sweep(spark, sf), "axis", "value")
    return rounded(tests).withColumn("f", F.round("f", 4))


@register("group_p_values")
def group_p_values(spark, sf):
    return rounded(resampling.with_p_values(resampling.group_tests(order_sweep(spark, sf), "axis", "value")).select("a", "b", "p", "p_corrected"))


RANKS_SQL = f"""WITH {SWEEP_SQL}, k AS (SELECT axis, setting, seed, max(value) FILTER (WHERE method = 'AF') AS af, max(value) FILTER (WHERE method = 'RF') AS rf, max(value) FILTER (WHERE method = 'NO') AS no FROM sweep GROUP BY ALL),
d AS (SELECT 'AF' AS a_method, 'RF' AS b_method, af - rf AS d FROM k WHERE af IS NOT NULL AND rf IS NOT NULL UNION ALL SELECT 'AF', 'NO', af - no FROM k WHERE af IS NOT NULL AND no IS NOT NULL),
n AS (SELECT a_method, b_method, count(*) AS n FROM d GROUP BY 1, 2),
r AS (SELECT a_method, b_method, d, rank() OVER (PARTITION BY a_method, b_method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a_method, b_method, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
s AS (SELECT a_method, b_method, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w FROM r GROUP BY 1, 2)"""


@register("paired_test_sums", RANKS_SQL + " SELECT a_method, b_method, n, round(CAST(w AS DOUBLE), 6) AS w FROM n JOIN s USING (a_method, b_method)")
def paired_test_sums(spark, sf):
    """The paired tests up to their p values."""
    return rounded(paired_test(order_sweep(spark, sf), [("AF", "RF"), ("AF", "NO")], UNITS).select("a_method", "b_method", "n", "w"))


# ---------------------------------------------------------------- slots

MERGES_SQL = """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
edges AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) > 0.3),
n AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM v), scan AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT n.i, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE b = n.id AND list_contains(kept, a)) THEN kept ELSE list_append(kept, n.id) END FROM scan JOIN n ON n.i = scan.i + 1
), kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM scan ORDER BY i DESC LIMIT 1))
SELECT b AS id, min(a) AS into_slot FROM edges WHERE a IN (SELECT id FROM kept) GROUP BY b
"""


@register("slot_moves", MERGES_SQL)
def slot_moves(spark, sf):
    """Every vector a slot: which earlier kept slot takes it."""
    slots = doubles(spark, sf).select(F.col("vec_id").alias("id"), F.lit(1.0).alias("count"), F.col("x").alias("vector"))
    return slot_merges.merge_slots(slots, 0.3)[1].select("id", F.col("into").alias("into_slot"))


@register(
    "merged_slots",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT client * 5 + t AS id, count(*) AS n FROM samples GROUP BY 1), l AS (SELECT client * 5 + t AS id, unnest(range(64)) AS i, unnest(x) AS v FROM samples),
m AS (SELECT id, i, avg(v) AS m FROM l GROUP BY 1, 2), p AS (SELECT a.id AS a, b.id AS b, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS s FROM m a JOIN m b ON a.i = b.i AND a.id < b.id GROUP BY 1, 2)
SELECT count(*) AS pairs, (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS rows FROM p WHERE s > 0.3""",
)
def merged_slots(spark, sf):
    """Fingerprints of batches as slots: pairs that are alike, and the rows that the merged slots stand for."""
    rows = vector_samples(spark, sf).select((F.col("client") * 5 + F.col("t")).alias("id"), F.posexplode("x").alias("i", "v"))
    means = rows.groupBy("id", "i").agg(F.avg("v").alias("v"), F.count("*").cast("double").alias("n"))
    slots = means.groupBy("id").agg(F.max("n").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("vector"))
    merged, _ = slot_merges.merge_slots(slots, 0.3)
    return slot_merges.alike_slots(slots, 0.3).agg(F.count("*").alias("pairs")).crossJoin(merged.agg(F.sum("count").alias("rows")))


# ---------------------------------------------------------------- folds and transport


@register(
    "fold_accuracy",
    f"""WITH {SAMPLES_SQL}, l AS (SELECT client, t AS fold, y, row_id, unnest(range(64)) AS i, unnest(x) AS v FROM samples),
s AS (SELECT client, y, i, fold, sum(v) AS s, count(*) AS n FROM l GROUP BY ALL), c AS (
  SELECT f.client, f.fold, s.y, s.i, sum(s.s) / sum(s.n) AS c FROM (SELECT DISTINCT client, fold FROM l) f JOIN s ON s.client = f.client AND s.fold <> f.fold GROUP BY ALL),
d AS (SELECT l.client, l.row_id, l.y, c.y AS k, round(sum(power(l.v - c.c, 2)), 9) AS d FROM l JOIN c ON c.client = l.client AND c.fold = l.fold AND c.i = l.i GROUP BY ALL),
b AS (SELECT client, row_id, y, k FROM d QUALIFY row_number() OVER (PARTITION BY client, row_id ORDER BY d, k) = 1)
SELECT client, count(*) AS n, round(avg(CAST(y = k AS DOUBLE)), 6) AS accuracy FROM b GROUP BY client""",
)
def fold_accuracy(spark, sf):
    return rounded(folds.nearest_centroid_accuracy(vector_samples(spark, sf), "client", "y", "row_id", fold=F.col("t")))


def _scaling_sql(rounds: int) -> str:
    steps = ["v0 AS (SELECT DISTINCT g, j, CAST(1 AS DOUBLE) AS v FROM k)"]
    for n in range(1, rounds + 1):
        steps.append(f"u{n} AS (SELECT g, i, max(a) / sum(k * v) AS u FROM k JOIN v{n - 1} USING (g, j) GROUP BY 1, 2)")
        steps.append(f"v{n} AS (SELECT g, j, max(b) / sum(k * u) AS v FROM k JOIN u{n} USING (g, i) GROUP BY 1, 2)")
    return ", ".join(steps)


#: Groups are vectors by number modulo 5; the even ones' class means are moved to the odd ones'.
TRANSPORT_SQL = f"""
WITH l AS (SELECT vec_id % 5 AS g, vec_id // 5 % 2 AS side, CAST(label AS BIGINT) AS y, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT g, side, y, i, avg(v) AS m, count(*) AS n FROM l GROUP BY ALL), w AS (SELECT g, side, y, max(n) / sum(max(n)) OVER (PARTITION BY g, side) AS w FROM m GROUP BY 1, 2, 3),
c AS (SELECT p.g, p.y AS i, q.y AS j, sqrt(sum(power(p.m - q.m, 2))) AS cost FROM m p JOIN m q ON p.g = q.g AND p.i = q.i AND p.side = 0 AND q.side = 1 GROUP BY 1, 2, 3),
k AS (SELECT c.g, c.i, c.j, cost, p.w AS a, q.w AS b, exp(-(cost - min(cost) OVER (PARTITION BY c.g)) / 0.2) AS k FROM c JOIN w p ON p.g = c.g AND p.side = 0 AND p.y = c.i JOIN w q ON q.g = c.g AND q.side = 1 AND q.y = c.j),
{_scaling_sql(6)}
SELECT g, round(sum(u * k * v * cost), 6) AS cost FROM k JOIN u6 USING (g, i) JOIN v6 USING (g, j) GROUP BY g
"""


@register("prototype_transport", TRANSPORT_SQL)
def prototype_transport(spark, sf):
    from pyspark.sql import Window

    rows = doubles(spark, sf).select((F.col("vec_id") % 5).alias("g"), (F.floor(F.col("vec_id") / 5) % 2).alias("side"), F.col("label").alias("y"), F.posexplode("x").alias("d", "v"))
    means = rows.groupBy("g", "side", "y", "d").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    own = means.groupBy("g", "side", "y").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("m"))
    own = own.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("g", "side")))
    side = lambda s, i, w, m: own.where(F.col("side") == s).select("g", F.col("y").alias(i), F.col("w").alias(w), F.col("m").alias(m))
    costs = side(0, "i", "a", "p").join(side(1, "j", "b", "q"), "g").select("g", "i", "j", F.sqrt(V.square_distance("p", "q")).alias("cost"), "a", "b")
    return rounded(transport.transport_costs(costs, ["g"], 0.2, 6))


# ---------------------------------------------------------------- nested results

#: Each event as a result document: a run, its metrics, and a curve of two places.
NESTED_SQL = """
WITH e AS (SELECT event_id, event_type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
p AS (
  SELECT event_type, '$.run' AS path, CAST(user_id AS DOUBLE) AS x FROM e UNION ALL SELECT event_type, '$.metrics.value', value FROM e
  UNION ALL SELECT event_type, '$.metrics.k', k FROM e UNION ALL SELECT event_type, '$.curve[]', value FROM e UNION ALL SELECT event_type, '$.curve[]', k FROM e
), n AS (
  SELECT event_type, path AS node, CASE path WHEN '$.run' THEN 2 ELSE 3 END AS depth, x FROM p UNION ALL SELECT event_type, '$', 1, x FROM p
  UNION ALL SELECT event_type, '$.metrics', 2, x FROM p WHERE path LIKE '$.metrics%' UNION ALL SELECT event_type, '$.curve', 2, x FROM p WHERE path LIKE '$.curve%'
)
SELECT event_type, node, CAST(depth AS BIGINT) AS depth, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(max(x), 6) AS high FROM n GROUP BY 1, 2, 3
"""


@register("nested_results", NESTED_SQL)
def nested_results(spark, sf):
    """Events as nested documents, flattened by path and rolled up along the paths."""
    from driftlake.operators import nested

    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    value = F.col("value").cast("string")
    text = F.concat(F.lit('{"run": '), F.col("user_id").cast("string"), F.lit(', "metrics": {"value": '), value, F.lit(', "k": '), F.col("k").cast("string"), F.lit('}, "curve": ['), value, F.lit(", "), F.col("k").cast("string"), F.lit("]}"))
    return rounded(nested.roll_up(nested.flatten(e.select("event_id", "event_type", text.alias("json")), ["event_id", "event_type"], "json"), ["event_type"]))


@register(
    "root_causes",
    """WITH r AS (SELECT l_suppkey % 5 AS seed, CASE l_linestatus WHEN 'O' THEN 'baseline' ELSE 'candidate' END AS side, l_quantity AS final, l_discount AS reuse, l_tax AS switches, l_extendedprice AS bytes FROM lineitem),
m AS (SELECT avg(final) FILTER (WHERE side = 'candidate') < avg(final) FILTER (WHERE side = 'baseline') - 1e-6 AS fell FROM r),
s AS (SELECT 'reuse' AS signal, 1 AS d, avg(reuse) FILTER (WHERE side = 'baseline') AS a, avg(reuse) FILTER (WHERE side = 'candidate') AS b FROM r UNION ALL SELECT 'switches', -1, avg(switches) FILTER (WHERE side = 'baseline'), avg(switches) FILTER (WHERE side = 'candidate') FROM r
  UNION ALL SELECT 'bytes', -1, avg(bytes) FILTER (WHERE side = 'baseline'), avg(bytes) FILTER (WHERE side = 'candidate') FROM r),
q AS (SELECT seed, avg(final) FILTER (WHERE side = 'baseline') AS a, avg(final) FILTER (WHERE side = 'candidate') AS b FROM r GROUP BY 1),
v AS (SELECT s.*, CASE WHEN abs(b - a) <= 1e-6 THEN 'same' WHEN (b - a) * d > 0 THEN 'better' WHEN fell THEN 'worse' ELSE 'tolerated' END AS verdict FROM s, m)
SELECT signal, round(a, 6) AS baseline, round(b, 6) AS candidate, round(b - a, 6) AS change, (SELECT count(*) FROM q WHERE b < a - 1e-6) AS seeds_worse, (SELECT count(*) FROM q) AS seeds, verdict,
  row_number() OVER (ORDER BY verdict <> 'worse', abs(b - a) / greatest(abs(a), 1e-12) DESC, signal) AS nth FROM v""",
)
def root_causes(spark, sf):
    from driftlake.operators import nested

    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("seed"), F.when(F.col("l_linestatus") == "O", "baseline").otherwise("candidate").alias("side"), F.col("l_quantity").alias("final"), F.col("l_discount").alias("reuse"), F.col("l_tax").alias("switches"), F.col("l_extendedprice").alias("bytes"))
    return rounded(nested.root_causes(rows, "final", {"reuse": 1, "switches": -1, "bytes": -1}))


# ---------------------------------------------------------------- regression

REGRESSION_SQL = """
WITH s AS (SELECT vec_id % 10 AS client, (vec_id // 10) % 5 AS t, vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, vec_id % 2 AS concept FROM embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY client, t ORDER BY row_id) <= count(*) OVER (PARTITION BY client, t) // 2 AS test FROM s),
m AS (SELECT client, t, concept, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) + 1e-6 AS xx, sum(x * y) AS xy FROM h WHERE NOT test GROUP BY 1, 2, 3),
f AS (SELECT client, t, concept, ((n + 1e-6) * xy - sx * sy) / ((n + 1e-6) * xx - sx * sx) AS w, (xx * sy - sx * xy) / ((n + 1e-6) * xx - sx * sx) AS b FROM m),
g AS (SELECT concept, t, avg(w) AS w, avg(b) AS b FROM f WHERE (t + 1) % 2 = 0 AND t < 4 GROUP BY 1, 2),
e AS (SELECT h.client, h.t, h.y, h.y - coalesce(g.w * h.x + g.b, 0) AS e FROM h LEFT JOIN g ON g.concept = h.concept AND g.t = (SELECT max(t) FROM g k WHERE k.concept = h.concept AND k.t < h.t) WHERE test)
SELECT client, t, round(avg(e * e), 6) AS mse, round(greatest(0.0, 1 - avg(e * e) / greatest(var_pop(y), 1e-12)), 6) AS r2 FROM e GROUP BY 1, 2
"""


@register("concept_regression", REGRESSION_SQL)
def concept_regression(spark, sf):
    """The second component of a vector from the first, one line a concept, averaged every second step."""
    from driftlake.operators import regression

    rows = vector_samples(spark, sf).select("client", "t", "row_id", F.slice("x", 1, 1).alias("x"), F.element_at("x", 2).alias("y"), (F.col("row_id") % 2).alias("concept"))
    return rounded(regression.prequential_regression(rows, 2, "concept"))


@register("mixture_lines")
def mixture_lines(spark, sf):
    """Each label's vectors are a client whose target is one of three planted lines; the lines found."""
    from driftlake.operators import regression

    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select((F.col("label") * 100 + F.col("vec_id") % 7).alias("client"), x.alias("x"), (F.col("label") % 3).alias("kind"))
    y = F.element_at("x", 1) * (F.col("kind") + 1) - F.element_at("x", 2) * F.col("kind") + F.col("kind")
    return rounded(regression.mixture_of_regressions(rows.select("client", "x", y.alias("y")), "client", 3)[1].select("line", F.posexplode("coef").alias("i", "coef")))


# ---------------------------------------------------------------- spectral clusters


@register("spectral_groups")
def spectral_groups(spark, sf):
    """All vectors as two groups, whatever their number."""
    from driftlake.operators import spectral

    rows = doubles(spark, sf).select((F.col("vec_id") % 2).alias("g"), F.col("vec_id").alias("id"), "x")
    return rounded(spectral.spectral_groups(rows, most=5, rounds=10))


# ---------------------------------------------------------------- curves and candidates


@register(
    "seed_curves",
    f"""WITH {GRID_SQL}, s AS (SELECT pred AS method, client % 3 AS seed, t, avg(acc) AS v FROM grid WHERE gt <> 4 GROUP BY 1, 2, 3)
SELECT method, t, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n FROM s GROUP BY 1, 2""",
)
def seed_curves(spark, sf):
    """Mean curves over seeds of the runs that are ok."""
    from driftlake.operators import sweep

    grid = event_grid(spark, sf)
    rows = grid.select(F.col("pred").alias("method"), (F.col("client") % 3).alias("seed"), "t", F.col("acc").alias("value"), F.when(F.col("gt") == 4, "failed").otherwise(" OK ").alias("status"))
    return rounded(sweep.curve_summary(rows, "status"))


@register(
    "candidates_with_current",
    f"""WITH {GRID_SQL}, p AS (SELECT client, t, unnest(range(5)) AS concept, gt, pred FROM grid), q AS (SELECT client, t, concept, pred, ((client * 7 + t * 3 + concept * 11) % 13 + 1) / 20.0 AS p FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY client, t ORDER BY p DESC, concept) AS rank FROM q) SELECT client, t, concept, rank FROM r WHERE rank <= 2 OR concept = pred""",
)
def candidates_with_current(spark, sf):
    """The two most probable concepts of each step and the one that is assigned."""
    from driftlake.operators import posterior

    concept = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("concept")
    rows = event_grid(spark, sf).select("client", "t", "pred", concept)
    rows = rows.withColumn("p", ((F.col("client") * 7 + F.col("t") * 3 + F.col("concept") * 11) % 13 + 1) / 20.0)
    return rounded(posterior.top_candidates(rows, ["client", "t"], 2, "pred").select("client", "t", "concept", "rank"))


# ---------------------------------------------------------------- the source by its name


@register("source_cells", "SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS client, t, CAST(20 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(19 AS BIGINT) AS last FROM supplier, (SELECT unnest(range(4)) AS t)")
def source_cells(spark, sf):
    """A dataset of the format drift with a client for each supplier: its cells."""
    from driftlake.sources import datasource

    datasource.register(spark)
    rows = spark.read.format("drift").option("clients", table(spark, sf, "supplier").count()).option("steps", 4).option("samples", 20).load()
    return rows.groupBy("client", "t").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@register("cached_moments", "WITH l AS (SELECT CAST(label AS BIGINT) AS label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, i, round(avg(v), 6) AS mean FROM l GROUP BY 1, 2")
def cached_moments(spark, sf):
    """Class means of vectors, from the cache in the shared folder once they are stored there."""
    from driftlake.sources.cache import cached
    from driftlake.sources.shared import shared_folder

    long = doubles(spark, sf).select("label", F.posexplode("x").alias("i", "v"))
    return rounded(cached(long.groupBy("label", "i").agg(F.avg("v").alias("mean")), f"{shared_folder(spark)}/results"))


@register(
    "fitted_shrinkage",
    SHRINKAGE_SQL
    + """, e AS (SELECT s, n * 20 AS own, greatest(0.0, s - 0.5 / (n * 20)) AS b FROM spread), k AS (SELECT count(DISTINCT client) AS clients, count(DISTINCT concept) AS concepts, count(DISTINCT idx) AS dimensions FROM params)
SELECT clients, concepts, dimensions, round(b, 6) AS between2, round(0.5 * dimensions / own / (0.5 * dimensions / own + b), 6) AS lam_iso, round(0.5 * 12 / own / (0.5 * 12 / own + b), 6) AS lam_aniso FROM e, k""",
)
def fitted_shrinkage(spark, sf):
    """The estimator with noise 0.5, 20 samples a client and 12 effective dimensions."""
    return rounded(shrinkage.fitted(vector_params(spark, sf), 0.5, 20, 12.0))


# ---------------------------------------------------------------- signatures and losses


def _matrix_sql(d: int, out: int, seed: int) -> str:
    from driftlake.operators import routing

    return "CAST([" + ", ".join("[" + ", ".join(repr(x) for x in row) + "]" for row in routing.projection(d, out, seed)) + "] AS DOUBLE[][])"


#: A vector's first 32 components are four rows of a classifier, its last 32 the rows before.
SIGNATURES_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), r AS (SELECT vec_id, x, unnest(range(4)) AS row FROM v),
n AS (SELECT vec_id, row, x[row * 8 + 1 : row * 8 + 8] AS now, x[row * 8 + 33 : row * 8 + 40] AS was FROM r), m AS (SELECT unnest({_matrix_sql(8, 3, 5)}) AS w, unnest(range(3)) AS j),
p AS (SELECT vec_id, row, j, list_inner_product(now, w) AS own, list_inner_product(now, w) - list_inner_product(was, w) AS delta FROM n, m)
SELECT vec_id, row, round(sum(own) FILTER (WHERE j = 0) / sqrt(sum(own * own)), 6) + 0.0 AS own, round(sum(delta) FILTER (WHERE j = 0) / sqrt(sum(delta * delta)), 6) + 0.0 AS delta FROM p GROUP BY 1, 2
"""


@register("classifier_signatures", SIGNATURES_SQL)
def classifier_signatures(spark, sf):
    """Signatures of classifiers' rows and of their changes: the first component of each."""
    from driftlake.operators import routing

    matrix = routing.projection(8, 3, 5)
    rows = lambda lo: F.array(*[F.slice("x", lo + 8 * i, 8) for i in range(4)])
    made = doubles(spark, sf).select("vec_id", F.posexplode(F.arrays_zip(routing.row_signatures(rows(1), matrix).alias("own"), routing.delta_signatures(rows(1), rows(33), matrix).alias("delta"))).alias("row", "s"))
    return rounded(made.select("vec_id", "row", F.element_at("s.own", 1).alias("own"), F.element_at("s.delta", 1).alias("delta")))


@register(
    "batch_signatures",
    f"""WITH {SAMPLES_SQL}, l AS (SELECT client, y, unnest(range(64)) AS i, unnest(x) AS v FROM samples), c AS (SELECT client, y, i, avg(v) AS m, count(*) AS n FROM l GROUP BY 1, 2, 3), t AS (SELECT client, count(*) AS n FROM samples GROUP BY 1),
r AS (SELECT client, y, i, m FROM c UNION ALL SELECT DISTINCT c.client, y, 64, c.n / t.n FROM c JOIN t USING (client)), w AS (SELECT j, i, w[i + 1] AS w FROM (SELECT w, j, unnest(range(65)) AS i FROM (SELECT unnest({_matrix_sql(65, 3, 6)}) AS w, unnest(range(3)) AS j))),
p AS (SELECT client, y, j, sum(m * w) AS p FROM r JOIN w USING (i) GROUP BY 1, 2, 3)
SELECT client, y, round(sum(p) FILTER (WHERE j = 0) / sqrt(sum(p * p)), 6) + 0.0 AS first FROM p GROUP BY 1, 2""",
)
def batch_signatures(spark, sf):
    """Signatures of clients' class means with the classes' shares."""
    from driftlake.operators import fingerprint, routing

    by = fingerprint.prototypes(vector_samples(spark, sf), ["client"]).groupBy("client").agg(F.array_sort(F.collect_list(F.struct("y", "mean", "n"))).alias("c"))
    made = routing.prototype_signatures(F.transform("c", lambda c: c["mean"]), F.transform("c", lambda c: c["n"]), routing.projection(65, 3, 6))
    return rounded(by.select("client", F.explode(F.arrays_zip(F.transform("c", lambda c: c["y"]).alias("y"), made.alias("s"))).alias("z")).select("client", F.col("z.y").alias("y"), F.element_at("z.s", 1).alias("first")))


@register(
    "hybrid_losses",
    """WITH p AS (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_quantity / 50.0 AS f, CASE WHEN l_linestatus = 'O' THEN l_discount * 10 END AS a, CASE WHEN l_returnflag <> 'N' THEN l_tax * 10 END AS b FROM lineitem),
w AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END AS t FROM p)
SELECT o, l, round((coalesce((1 - a) * 0.6, 0) + coalesce((1 - b) * 0.4, 0) + CASE WHEN t < 1 THEN 1 - t ELSE 1 END * f) / (t + CASE WHEN t < 1 THEN 1 - t ELSE 1 END), 6) AS loss FROM w""",
)
def hybrid_losses(spark, sf):
    """A fingerprint's loss mixed with the similarities that are known."""
    from driftlake.operators import routing

    rows = table(spark, sf, "lineitem")
    parts = {"signature": (F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 10), 0.6), "update": (F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 10), 0.4), "unused": (F.lit(None).cast("double"), 0.0)}
    return rounded(rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), routing.hybrid_loss(F.col("l_quantity") / 50.0, parts).alias("loss")))


@register(
    "identity_validity",
    """WITH m AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'FeSEM' WHEN 1 THEN 'IFCA' WHEN 2 THEN 'FedAvg' WHEN 3 THEN 'Own-' || o_orderpriority ELSE 'Other' END AS method FROM orders)
SELECT method, count(*) AS n, method IN ('FeSEM', 'IFCA') OR method LIKE 'Own-%' AS valid FROM m GROUP BY 1""",
)
def identity_validity(spark, sf):
    from driftlake.functions import scalars

    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "FeSEM").when(k == 1, "IFCA").when(k == 2, "FedAvg").when(k == 3, F.concat(F.lit("Own-"), "o_orderpriority")).otherwise("Other")
    rows = table(spark, sf, "orders").select(name.alias("method")).groupBy("method").agg(F.count("*").alias("n"))
    return rows.select("method", "n", scalars.identity_valid(F.col("method"), ["IFCA", "Own"], {"FeSEM": "IFCA"}, ("Own",)).alias("valid"))


# ---------------------------------------------------------------- draws from shares

#: Nations are clients with four steps; their customers' shares of ten labels are drawn from vectors of these labels.
SHARES_SQL = f"""
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS client, c_custkey % 10 AS label, count(*) AS n FROM customer GROUP BY 1, 2), p AS (SELECT client, label, n / sum(n) OVER (PARTITION BY client) * 20 AS e FROM c),
r AS (SELECT client, label, CAST(floor(e) AS BIGINT) AS f, 20 - sum(CAST(floor(e) AS BIGINT)) OVER (PARTITION BY client) AS rest, row_number() OVER (PARTITION BY client ORDER BY e - floor(e) DESC, label) AS nth FROM p),
counts AS (SELECT client, label, CAST(f + CASE WHEN nth <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM r),
wanted AS (SELECT client, t, label, n FROM counts, (SELECT unnest(range(4)) AS t) WHERE n > 0),
serves AS (SELECT label, max(n) AS most, size // max(n) AS slots, CAST(ceil(count(*) / (size // max(n))) AS BIGINT) AS epochs FROM wanted JOIN (SELECT CAST(label AS BIGINT) AS label, count(*) AS size FROM embeddings GROUP BY 1) USING (label) GROUP BY label, size),
cells AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {unit_sql("'42|' || client || '|' || t")}, client, t) - 1 AS nth FROM wanted),
places AS (SELECT client, t, label, nth // slots AS epoch, nth % slots * most + unnest(range(n)) AS nth FROM cells JOIN serves USING (label)),
ordered AS (SELECT label, epoch, row_id, row_number() OVER (PARTITION BY label, epoch ORDER BY {unit_sql("'42|' || epoch || '|' || row_id")}, row_id) - 1 AS nth
  FROM (SELECT CAST(e.label AS BIGINT) AS label, vec_id AS row_id, unnest(range(epochs)) AS epoch FROM embeddings e JOIN serves s ON s.label = e.label))
SELECT client, t, label, row_id FROM places JOIN ordered USING (label, epoch, nth)
"""


@register("share_draws", SHARES_SQL)
def share_draws(spark, sf):
    """Twenty rows a cell by the client's own shares of labels."""
    from pyspark.sql import Window

    from driftlake.sources import generators

    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("client"), (F.col("c_custkey") % 10).alias("label")).agg(F.count("*").alias("c"))
    shares = c.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("client")))
    counts = generators.largest_remainder(shares, ["client"], "share", 20, "label").select("client", "label", "n")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("t")
    grid = counts.select("client").distinct().select("client", steps, F.lit(0).cast("long").alias("concept"))
    pool = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"))
    return pools.pool_recurrence(pool, grid, counts).select("client", "t", "label", "row_id")
