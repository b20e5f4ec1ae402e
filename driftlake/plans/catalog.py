"""Queries over the reference tables and the SQL that checks them.

Each entry applies one operator to a canonical view of the driver's tables. Floats
are rounded to six places on both sides, since sums are added in another order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import budget, identity, sweep
from driftlake.sources.views import BUDGET_SQL, GRID_SQL, SWEEP_SQL, event_grid, order_budget, order_sweep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places (or as many as asked for), whole numbers to bigint; -0.0 becomes 0.0."""
    kind = dict(df.dtypes)
    cast = lambda c: (F.round(F.col(c), digits) + 0.0) if kind[c] in ("double", "float") else F.col(c).cast("long") if kind[c] in ("int", "smallint") else F.col(c)
    return df.select(*[cast(c).alias(c) for c in df.columns])


# ---------------------------------------------------------------- identity

MAPPED_SQL = f"""
WITH RECURSIVE {GRID_SQL},
five AS (SELECT unnest(range(5)) AS id),
cells AS (
  SELECT p.id AS pred, g.id AS gt, count(c.client) AS n
  FROM five p CROSS JOIN five g LEFT JOIN grid c ON c.pred = p.id AND c.gt = g.id GROUP BY 1, 2
),
perms AS (
  SELECT 0 AS k, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS hits
  UNION ALL
  SELECT k + 1, list_append(ids, gt), CAST(hits + n AS BIGINT)
  FROM perms JOIN cells ON cells.pred = k WHERE k < 5 AND NOT list_contains(ids, gt)
),
best AS (SELECT ids FROM perms WHERE k = 5 ORDER BY hits DESC, ids LIMIT 1),
aligned AS (SELECT grid.*, ids[pred + 1] AS aligned FROM grid, best)
"""


@register(
    "grid_metrics",
    MAPPED_SQL
    + """
, lagged AS (SELECT *, lag(gt) OVER (PARTITION BY client ORDER BY t) AS was_gt, lag(pred) OVER (PARTITION BY client ORDER BY t) AS was_pred FROM aligned)
SELECT count(*) AS cells, count(DISTINCT client) AS clients, round(avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS re_id,
       round(1 - avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS wrong_reuse,
       count(*) FILTER (WHERE gt <> was_gt) AS drifts, round(avg(CASE WHEN was_pred IS NULL THEN NULL WHEN pred <> was_pred THEN 1.0 ELSE 0.0 END), 6) AS switch_rate,
       round(avg(acc), 6) AS accuracy
FROM lagged""",
)
def grid_metrics(spark, sf):
    """The bundle of a run's metrics in one row: one shuffle by client and one of partial sums."""
    w = identity.by_client()
    grid = identity.align(event_grid(spark, sf))
    rows = grid.select("client", "acc", (F.col("aligned") == F.col("gt")).cast("double").alias("hit"), (F.col("gt") != F.lag("gt").over(w)).alias("drift"), (F.col("pred") != F.lag("pred").over(w)).cast("double").alias("switch"))
    return rounded(
        rows.agg(
            F.count("*").alias("cells"), F.countDistinct("client").alias("clients"), F.avg("hit").alias("re_id"), (1 - F.avg("hit")).alias("wrong_reuse"),
            F.count(F.when(F.col("drift"), 1)).alias("drifts"), F.avg("switch").alias("switch_rate"), F.avg("acc").alias("accuracy"),
        )
    )


@register(
    "re_id_accuracy_grouping_sets",
    MAPPED_SQL
    + """
SELECT CAST(level AS BIGINT) AS level, client, t, round(accuracy, 6) AS accuracy, cells FROM (
  SELECT grouping(client) * 2 + grouping(t) AS level, client, t, avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS cells
  FROM aligned GROUP BY GROUPING SETS ((), (client), (t)))""",
)
def re_id_accuracy(spark, sf):
    return rounded(identity.re_id_accuracy(event_grid(spark, sf)))


@register("clustering_error", MAPPED_SQL + "SELECT round(avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS re_id, round(1 - avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS wrong_reuse, count(*) AS cells FROM aligned")
def clustering_error(spark, sf):
    return rounded(identity.overall(event_grid(spark, sf)))


@register(
    "greedy_tracking_accuracy",
    f"""WITH RECURSIVE {GRID_SQL}, cells AS (SELECT pred, gt, count(*) AS n FROM grid GROUP BY 1, 2), best AS (
  SELECT pred, gt, row_number() OVER (ORDER BY n DESC, pred, gt) AS nth, n FROM cells), steps AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS preds, CAST([] AS BIGINT[]) AS gts, CAST(0 AS BIGINT) AS hits
  UNION ALL
  SELECT b.nth, CASE WHEN free THEN list_append(preds, b.pred) ELSE preds END, CASE WHEN free THEN list_append(gts, b.gt) ELSE gts END, CAST(hits + CASE WHEN free THEN b.n ELSE 0 END AS BIGINT)
  FROM (SELECT b.*, s.preds, s.gts, s.hits, NOT list_contains(s.preds, b.pred) AND NOT list_contains(s.gts, b.gt) AS free FROM steps s JOIN best b ON b.nth = s.nth + 1) b)
SELECT round(max(hits) / (SELECT count(*) FROM grid), 6) AS tracking_accuracy FROM steps""",
)
def greedy_tracking(spark, sf):
    return rounded(identity.tracking_accuracy(event_grid(spark, sf)))


@register("contingency", f"WITH {GRID_SQL} SELECT pred, gt, count(*) AS n FROM grid GROUP BY 1, 2")
def contingency(spark, sf):
    return identity.contingency(event_grid(spark, sf))


@register(
    "drift_points",
    f"""WITH {GRID_SQL}, l AS (SELECT *, lag(gt) OVER (PARTITION BY client ORDER BY t) AS was FROM grid)
SELECT client, t, was AS from_concept, gt AS to_concept FROM l WHERE gt <> was""",
)
def drift_points(spark, sf):
    return identity.drift_points(event_grid(spark, sf))


@register(
    "assignment_switch_rate",
    f"""WITH {GRID_SQL}, l AS (SELECT pred, lag(pred) OVER (PARTITION BY client ORDER BY t) AS was FROM grid)
SELECT round(coalesce(avg(CASE WHEN pred <> was THEN 1.0 ELSE 0.0 END), 0.0), 6) AS switch_rate, count(*) AS transitions FROM l WHERE was IS NOT NULL""",
)
def switch_rate(spark, sf):
    return rounded(identity.switch_rate(event_grid(spark, sf)))


@register(
    "group_metrics",
    f"""WITH {GRID_SQL}, s AS (SELECT t, pred, count(*) AS size FROM grid GROUP BY 1, 2)
SELECT round(avg(size), 6) AS clients_per_concept, round(count(*) FILTER (WHERE size = 1) / count(*), 6) AS singleton_groups,
       round(count(*) FILTER (WHERE size = 1) / sum(size), 6) AS singleton_cells, min(size) AS min_size, max(size) AS max_size FROM s""",
)
def group_metrics(spark, sf):
    return rounded(identity.group_metrics(event_grid(spark, sf)))


@register(
    "step_groups",
    f"""WITH {GRID_SQL}, s AS (SELECT t, gt, count(*) AS size FROM grid GROUP BY 1, 2)
SELECT t, count(*) AS active, min(size) AS least, round(avg(size), 6) AS mean, max(size) AS most FROM s GROUP BY t""",
)
def step_groups(spark, sf):
    return rounded(identity.step_groups(event_grid(spark, sf)))


@register(
    "memory_reuse_rate",
    MAPPED_SQL
    + """, r AS (SELECT client, CASE WHEN row_number() OVER (PARTITION BY client, aligned ORDER BY t) > 1 THEN 1 ELSE 0 END AS again FROM aligned)
SELECT round(sum(again) / (count(*) - count(DISTINCT client)), 6) AS reuse_rate, CAST(sum(again) AS BIGINT) AS reused FROM r""",
)
def memory_reuse(spark, sf):
    return rounded(identity.memory_reuse(event_grid(spark, sf)))


@register(
    "recurrence_ratio",
    f"""WITH {GRID_SQL}, r AS (SELECT CASE WHEN row_number() OVER (PARTITION BY client, gt ORDER BY t) > 1 THEN 1.0 ELSE 0.0 END AS again FROM grid)
SELECT round(avg(again), 6) AS recurrence_ratio FROM r""",
)
def recurrence(spark, sf):
    return rounded(identity.recurrence(event_grid(spark, sf)))


@register(
    "recurrence_events",
    f"""WITH {GRID_SQL}, r AS (SELECT client, t, lag(t) OVER (PARTITION BY client, gt ORDER BY t) AS before, gt AS concept FROM grid)
SELECT client, t, before, concept FROM r WHERE t - before > 1""",
)
def recurrence_events(spark, sf):
    return identity.recurrence_events(event_grid(spark, sf))


@register(
    "knowledge_preservation",
    f"""WITH {GRID_SQL}, r AS (SELECT t, acc, lag(t) OVER w AS before, lag(acc) OVER w AS was FROM grid WINDOW w AS (PARTITION BY client, gt ORDER BY t))
SELECT round(coalesce(avg(acc / was), 1.0), 6) AS preservation, count(*) AS events FROM r WHERE t - before > 1 AND was > 0.05""",
)
def knowledge_kept(spark, sf):
    return rounded(identity.knowledge_kept(event_grid(spark, sf)))


@register(
    "recovery_gap",
    f"""WITH {GRID_SQL}, r AS (SELECT client, t, acc, lag(t) OVER (PARTITION BY client, gt ORDER BY t) AS before FROM grid),
base AS (SELECT client, t, acc / 2 + 0.1 AS base FROM grid)
SELECT round(coalesce(avg(acc - base), 0.0), 6) AS recovery_gap, count(*) AS events FROM r JOIN base USING (client, t) WHERE t - before > 1""",
)
def recovery_gap(spark, sf):
    grid = event_grid(spark, sf)
    return rounded(identity.recovery_gap(grid, grid.withColumn("acc", F.col("acc") / 2 + 0.1)))


@register(
    "time_to_recovery",
    f"""WITH {GRID_SQL}, c AS (SELECT *, max(acc) OVER (PARTITION BY client, gt) AS peak,
  CASE WHEN gt <> lag(gt) OVER (PARTITION BY client ORDER BY t) THEN 1 ELSE 0 END AS new FROM grid),
r AS (SELECT *, sum(new) OVER (PARTITION BY client ORDER BY t) AS run FROM c),
d AS (SELECT *, t - min(t) OVER (PARTITION BY client, run) AS dt FROM r)
SELECT client, min(t) AS t, coalesce(min(dt) FILTER (WHERE acc >= 0.8 * peak), 5) AS steps FROM d WHERE run > 0 AND dt <= 5 GROUP BY client, run""",
)
def time_to_recovery(spark, sf):
    return identity.time_to_recovery(event_grid(spark, sf))


@register(
    "hard_assignment_entropy",
    f"""WITH {GRID_SQL}, c AS (SELECT t, pred, count(*) AS c FROM grid WHERE pred < (SELECT max(gt) + 1 FROM grid) GROUP BY 1, 2),
p AS (SELECT t, c / sum(c) OVER (PARTITION BY t) AS p FROM c)
SELECT t, round(sum(-p * ln(p)) + ((SELECT max(gt) + 1 FROM grid) - count(*)) * -1e-12 * ln(1e-12), 6) + 0.0 AS entropy FROM p GROUP BY t""",
)
def hard_entropy(spark, sf):
    return rounded(identity.hard_entropy(event_grid(spark, sf)))


SOFT_SQL = f"""WITH {GRID_SQL}, soft AS (
  SELECT client, t, pred AS concept, 0.7 AS p FROM grid WHERE t % 4 <> 3 UNION ALL
  SELECT client, t, (pred + 1 + t % 3) % 5 AS concept, 0.3 AS p FROM grid WHERE t % 4 <> 3 UNION ALL
  SELECT client, t, 0 AS concept, 0.0 AS p FROM grid WHERE t % 4 = 3)"""


def soft(spark, sf):
    grid = event_grid(spark, sf)
    on = grid.where("t % 4 <> 3")
    one = on.select("client", "t", F.col("pred").alias("concept"), F.lit(0.7).alias("p"))
    two = on.select("client", "t", ((F.col("pred") + 1 + F.col("t") % 3) % 5).alias("concept"), F.lit(0.3).alias("p"))
    return one.unionByName(two).unionByName(grid.where("t % 4 = 3").select("client", "t", F.lit(0).cast("long").alias("concept"), F.lit(0.0).alias("p")))


@register("soft_assignment_entropy", SOFT_SQL + ", c AS (SELECT client, t, sum(-greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS h, sum(p) AS m FROM soft GROUP BY 1, 2) SELECT round(coalesce(avg(h) FILTER (WHERE m > 1e-12), avg(h)), 6) AS soft_entropy FROM c")
def soft_entropy(spark, sf):
    return rounded(identity.soft_entropy(soft(spark, sf)))


@register(
    "routing_consistency",
    SOFT_SQL
    + """, cells AS (SELECT g.client, g.t, i.id AS concept FROM grid g, (SELECT unnest(range(5)) AS id) i),
dense AS (SELECT c.client, c.t, c.concept, coalesce(sum(s.p), 0) AS p FROM cells c LEFT JOIN soft s USING (client, t, concept) GROUP BY 1, 2, 3),
d AS (SELECT client, t, abs(p - lag(p) OVER (PARTITION BY client, concept ORDER BY t)) AS d FROM dense),
tv AS (SELECT client, t, greatest(0, least(1, sum(d) / 2)) AS tv FROM d WHERE t > 0 GROUP BY 1, 2)
SELECT round(1 - coalesce(avg(tv), 0), 6) AS routing_consistency FROM tv""",
)
def routing_consistency(spark, sf):
    return rounded(identity.routing_consistency(soft(spark, sf).groupBy("client", "t", "concept").agg(F.sum("p").alias("p"))))


@register("carry_forward", f"WITH {GRID_SQL} SELECT client, t, last_value(CASE WHEN (t + 1) % 5 = 0 THEN pred END IGNORE NULLS) OVER (PARTITION BY client ORDER BY t) AS pred FROM grid")
def carry_forward(spark, sf):
    return identity.carry_forward(event_grid(spark, sf), 5)


@register("running_accuracy", f"WITH {GRID_SQL} SELECT client, t, round(avg(CASE WHEN pred = gt THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY client ORDER BY t), 6) AS accuracy FROM grid")
def running_accuracy(spark, sf):
    return rounded(identity.running_accuracy(event_grid(spark, sf)))


@register(
    "faded_accuracy",
    f"""WITH {GRID_SQL} SELECT a.client, a.t, round(sum(CASE WHEN b.pred = b.gt THEN power(0.9, a.t - b.t) ELSE 0 END) / sum(power(0.9, a.t - b.t)), 6) AS accuracy
FROM grid a JOIN grid b ON a.client = b.client AND b.t <= a.t GROUP BY 1, 2""",
)
def faded_accuracy(spark, sf):
    return rounded(identity.running_accuracy(event_grid(spark, sf), 0.9))


@register(
    "novelty_streaks",
    f"""WITH {GRID_SQL}, i AS (SELECT client, t, pred = 0 AS novel, sum(CASE WHEN pred <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY t) AS island FROM grid)
SELECT client, t, CAST(sum(CASE WHEN novel THEN 1 ELSE 0 END) OVER (PARTITION BY client, island ORDER BY t) AS BIGINT) AS streak FROM i""",
)
def novelty_streaks(spark, sf):
    return identity.novelty_streaks(event_grid(spark, sf), F.col("pred") == 0)


@register(
    "forgetting_and_transfer",
    f"""WITH {GRID_SQL}, s AS (SELECT gt, t, avg(acc) AS a FROM grid GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY t DESC) AS back FROM s),
b AS (SELECT gt, max(a) FILTER (WHERE back > 1) AS best, max_by(a, t) AS last, min_by(a, t) AS first, count(*) AS n FROM r GROUP BY gt)
SELECT round(coalesce(avg(best - last), 0), 6) AS forgetting, round(coalesce(avg(last - first), 0), 6) AS backward_transfer FROM b WHERE n >= 2""",
)
def forgetting(spark, sf):
    return rounded(identity.forgetting(event_grid(spark, sf)))


@register(
    "detection_metrics",
    f"""WITH {GRID_SQL}, l AS (SELECT client, t, gt, pred, lag(gt) OVER w AS wg, lag(pred) OVER w AS wp FROM grid WINDOW w AS (PARTITION BY client ORDER BY t)),
c AS (SELECT client, t, coalesce(gt <> wg, false) AS d, coalesce(pred <> wp, false) AS f FROM l),
w AS (SELECT avg(later) AS delay FROM (SELECT (SELECT min(x.t) FROM c x WHERE x.client = c.client AND x.f AND x.t >= c.t) - c.t AS later FROM c WHERE d))
SELECT round(count(*) FILTER (WHERE f) / count(*) FILTER (WHERE d), 6) AS detection_rate, round(greatest(count(*) FILTER (WHERE f) - count(*) FILTER (WHERE d), 0) / count(*) FILTER (WHERE f), 6) AS false_alarm_rate,
       round(count(*) FILTER (WHERE d AND f) / count(*) FILTER (WHERE d), 6) AS hit_rate, round(count(*) FILTER (WHERE f AND NOT d) / count(*) FILTER (WHERE f), 6) AS miss_share,
       round(count(*) FILTER (WHERE d AND f) / count(*) FILTER (WHERE f), 6) AS identification_accuracy, round(coalesce(max(delay), 0.0), 6) AS mean_delay,
       count(*) FILTER (WHERE d) AS true_drifts, count(*) FILTER (WHERE f) AS detections FROM c, w""",
)
def detection_metrics(spark, sf):
    grid = event_grid(spark, sf)
    fired = identity.drift_points(grid.select("client", "t", F.col("pred").alias("gt")))
    return rounded(identity.detection_metrics(identity.drift_points(grid), fired))


@register(
    "round_summary",
    f"""WITH {GRID_SQL}, r AS (SELECT CAST(floor(t / 5) AS BIGINT) AS round, acc, CASE WHEN pred <> lag(pred) OVER (PARTITION BY client ORDER BY t) THEN 1 ELSE 0 END AS s,
  CASE WHEN row_number() OVER (PARTITION BY client, pred ORDER BY t) = 1 THEN 1 ELSE 0 END AS n FROM grid)
SELECT round, count(*) AS cells, CAST(sum(s) AS BIGINT) AS switches, CAST(sum(n) AS BIGINT) AS novel, round(avg(acc), 6) AS accuracy FROM r GROUP BY round""",
)
def round_summary(spark, sf):
    return rounded(identity.round_summary(event_grid(spark, sf), 5))


# ---------------------------------------------------------------- budget


@register(
    "accuracy_auc",
    f"""WITH {GRID_SQL}, c AS (SELECT t, avg(acc) AS a FROM grid GROUP BY t), p AS (SELECT a, lead(a) OVER (ORDER BY t) AS b FROM c)
SELECT round(sum((a + b) / 2), 6) AS auc, count(*) AS steps FROM p""",
)
def accuracy_auc(spark, sf):
    return rounded(budget.accuracy_auc(event_grid(spark, sf)))


@register("mean_curve", f"WITH {GRID_SQL} SELECT t, round(avg(acc), 6) AS acc FROM grid GROUP BY t")
def mean_curve(spark, sf):
    return rounded(budget.mean_curve(event_grid(spark, sf)))


DIPS_SQL = f"""WITH {GRID_SQL}, l AS (SELECT client, t, gt, lag(gt) OVER (PARTITION BY client ORDER BY t) AS was FROM grid),
c AS (SELECT t, avg(acc) AS a FROM grid GROUP BY t), last AS (SELECT max(t) AS last FROM c),
s AS (SELECT c.t, p.a AS pre, (SELECT min(x.a) FROM c x WHERE x.t BETWEEN c.t AND c.t + 2) AS low,
  (SELECT min(x.t) FROM c x WHERE x.t BETWEEN c.t AND c.t + 5 AND x.a >= 0.95 * p.a) AS hit FROM c JOIN c p ON p.t = c.t - 1),
d AS (SELECT l.client, l.t, round(greatest(pre - low, 0.0), 6) + 0.0 AS dip, coalesce(hit - l.t, 6) AS recovery FROM l JOIN s USING (t), last WHERE gt <> was AND l.t < last)"""


@register("drift_dips", DIPS_SQL + " SELECT client, t, dip, recovery FROM d")
def dips(spark, sf):
    return rounded(budget.dips(event_grid(spark, sf)))


@register("worst_dip", DIPS_SQL + " SELECT greatest(max(dip), 0.0) AS worst_dip, max(recovery) AS worst_recovery FROM d")
def worst_dip(spark, sf):
    return rounded(budget.worst_dip(event_grid(spark, sf)))


@register(
    "budget_scores",
    f"WITH {BUDGET_SQL} SELECT method, federation_every, total_bytes, round(accuracy_auc / total_bytes, 12) AS score FROM budget",
)
def budget_scores(spark, sf):
    points = order_budget(spark, sf)
    return points.select("method", "federation_every", "total_bytes", F.round(budget.budget_score(F.col("accuracy_auc"), F.col("total_bytes")), 12).alias("score"))


@register(
    "pareto_front",
    f"""WITH {BUDGET_SQL} SELECT * FROM budget p WHERE NOT EXISTS (SELECT 1 FROM budget q WHERE q.accuracy_auc >= p.accuracy_auc AND q.total_bytes <= p.total_bytes
  AND (q.accuracy_auc > p.accuracy_auc OR q.total_bytes < p.total_bytes))""",
)
def pareto(spark, sf):
    return budget.pareto(order_budget(spark, sf)).select("method", "federation_every", "total_bytes", "accuracy_auc")


@register(
    "budget_crossovers",
    f"""WITH {BUDGET_SQL}, two AS (SELECT method, total_bytes AS x, accuracy_auc AS y FROM budget WHERE method IN ('1-URGENT', '5-LOW')),
e AS (SELECT max(lo) AS lo, min(hi) AS hi, max(n) * 10 AS steps FROM (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM two GROUP BY method HAVING count(*) > 1) HAVING count(*) = 2),
p AS (SELECT method, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM two WINDOW w AS (PARTITION BY method ORDER BY x)),
i AS (SELECT lo, hi, steps, unnest(range(steps)) AS i FROM e WHERE lo < hi), g AS (SELECT i, CASE WHEN i = steps - 1 THEN hi ELSE lo + i * ((hi - lo) / (steps - 1)) END AS g FROM i),
v AS (SELECT i, g, max(CASE WHEN method = '1-URGENT' THEN y + (y2 - y) / (x2 - x) * (g - x) END) AS a, max(CASE WHEN method = '5-LOW' THEN y + (y2 - y) / (x2 - x) * (g - x) END) AS b FROM g JOIN p ON x2 > x AND g BETWEEN x AND x2 GROUP BY 1, 2),
d AS (SELECT g, a, a - b AS d, lead(g) OVER w AS g2, lead(a) OVER w AS a2, lead(a - b) OVER w AS d2 FROM v WINDOW w AS (ORDER BY i)),
t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d * d2 < 0 THEN d / (d - d2) END AS t FROM d WHERE d2 IS NOT NULL)
SELECT round(g + t * (g2 - g), 4) AS total_bytes, round(a + t * (a2 - a), 4) AS accuracy_auc FROM t WHERE t IS NOT NULL""",
)
def crossovers(spark, sf):
    return rounded(budget.crossovers(order_budget(spark, sf), "1-URGENT", "5-LOW"), 4)


@register(
    "frontier_gate",
    f"""WITH {BUDGET_SQL}, a AS (SELECT * FROM budget WHERE method <> '5-LOW'),
k AS (SELECT count(*) AS n FROM a p WHERE method = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM a q WHERE q.accuracy_auc >= p.accuracy_auc AND q.total_bytes <= p.total_bytes AND (q.accuracy_auc > p.accuracy_auc OR q.total_bytes < p.total_bytes))),
b AS (SELECT method FROM budget ORDER BY accuracy_auc / total_bytes DESC, method DESC LIMIT 1)
SELECT n AS not_beaten, method AS best_method, n > 0 OR method = '1-URGENT' AS passed FROM k, b""",
)
def frontier_gate(spark, sf):
    return budget.frontier_gate(order_budget(spark, sf), ["1-URGENT"], ["5-LOW"])


@register("identity_gate", f"WITH {SWEEP_SQL}, m AS (SELECT avg(value) FILTER (WHERE method = 'NO') AS a, avg(value) FILTER (WHERE method = 'AF') AS b FROM sweep) SELECT round(a, 6) AS ours, round(b, 6) AS other, round(a - b, 6) AS gap, a >= b AS passed FROM m")
def identity_gate(spark, sf):
    return rounded(budget.identity_gate(order_sweep(spark, sf), "NO", "AF", "value"))


@register(
    "all_metrics",
    MAPPED_SQL
    + """
, lagged AS (SELECT *, lag(pred) OVER (PARTITION BY client ORDER BY t) AS was_pred, lag(gt) OVER (PARTITION BY client ORDER BY t) AS was_gt, row_number() OVER (PARTITION BY client, aligned ORDER BY t) > 1 AS again FROM aligned),
sizes AS (SELECT t, pred, count(*) AS size FROM grid GROUP BY 1, 2), n AS (SELECT max(gt) + 1 AS n FROM grid),
p AS (SELECT t, size / sum(size) OVER (PARTITION BY t) AS p, n FROM sizes, n WHERE pred >= 0 AND pred < n),
h AS (SELECT t, sum(-p * ln(p)) + (max(n) - count(*)) * -1e-12 * ln(1e-12) AS h FROM p GROUP BY t),
c AS (SELECT t, avg(acc) AS a FROM grid GROUP BY t), last AS (SELECT max(t) AS last FROM c),
auc AS (SELECT sum((a + b) / 2) AS auc FROM (SELECT a, lead(a) OVER (ORDER BY t) AS b FROM c)),
s AS (SELECT c.t, p.a AS pre, (SELECT min(x.a) FROM c x WHERE x.t BETWEEN c.t AND c.t + 2) AS low, (SELECT min(x.t) FROM c x WHERE x.t BETWEEN c.t AND c.t + 5 AND x.a >= 0.95 * p.a) AS hit FROM c JOIN c p ON p.t = c.t - 1),
d AS (SELECT greatest(pre - low, 0.0) AS dip, coalesce(hit - l.t, 6) AS recovery FROM lagged l JOIN s USING (t), last WHERE gt <> was_gt AND l.t < last)
SELECT round(avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS re_id, round((SELECT avg(h) FROM h), 6) AS assignment_entropy,
  round(avg(CASE WHEN was_pred IS NULL THEN NULL WHEN pred <> was_pred THEN 1.0 ELSE 0.0 END), 6) AS switch_rate, round((SELECT avg(size) FROM sizes), 6) AS clients_per_concept,
  round((SELECT avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END) FROM sizes), 6) AS singleton_groups, round(sum(CASE WHEN again THEN 1.0 ELSE 0.0 END) / (count(*) - count(DISTINCT client)), 6) AS reuse_rate,
  round(1 - avg(CASE WHEN was_pred IS NULL THEN NULL WHEN pred <> was_pred THEN 1.0 ELSE 0.0 END), 6) AS routing_consistency, round(1 - avg(CASE WHEN aligned = gt THEN 1.0 ELSE 0.0 END), 6) AS wrong_reuse,
  round((SELECT a FROM c, last WHERE t = last), 6) AS final_accuracy, round((SELECT auc FROM auc), 6) AS accuracy_auc, round((SELECT max(dip) FROM d), 6) AS worst_dip, (SELECT max(recovery) FROM d) AS worst_recovery,
  round((SELECT auc FROM auc) / 5000.0, 6) AS budget_score FROM lagged""",
)
def all_metrics(spark, sf):
    return rounded(identity.all_metrics(event_grid(spark, sf), 5000.0))


@register(
    "metrics_without_identity",
    f"""WITH {GRID_SQL}, c AS (SELECT t, avg(acc) AS a FROM grid GROUP BY t) SELECT CAST(NULL AS DOUBLE) AS re_id, CAST(NULL AS DOUBLE) AS switch_rate, CAST(NULL AS DOUBLE) AS wrong_reuse, CAST(NULL AS DOUBLE) AS budget_score, round(max_by(a, t), 6) AS final_accuracy FROM c""",
)
def metrics_without_identity(spark, sf):
    return rounded(identity.all_metrics(event_grid(spark, sf), identity_capable=False).select("re_id", "switch_rate", "wrong_reuse", "budget_score", "final_accuracy"))


@register(
    "communication_bytes",
    """SELECT CAST(label AS BIGINT) AS concept, sum(len(embedding)) * 32 / 8.0 AS model_bytes, (10 + 10 * 64 + 64) * 16 / 8.0 AS fingerprint_bytes,
  count(*) * 5 * 2 * 650 * 32 / 8.0 AS fedavg_bytes FROM embeddings GROUP BY label""",
)
def communication(spark, sf):
    from driftlake.sources.views import table

    rows = table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("concept")).agg(F.sum(F.size("embedding")).alias("n"), F.count("*").alias("k"))
    return rows.select(
        "concept", (F.col("n") * 32 / 8).alias("model_bytes"), budget.fingerprint_bytes(F.lit(64), F.lit(10), 16).cast("double").alias("fingerprint_bytes"),
        budget.fedavg_bytes(F.col("k"), F.lit(5), F.lit(650)).cast("double").alias("fedavg_bytes"),
    )


# ---------------------------------------------------------------- sweeps

SETTING = ["axis", "setting", "seed"]


@register(
    "axis_statistics",
    f"""WITH {SWEEP_SQL} SELECT 'axis' AS axis_name, CAST(axis AS VARCHAR) AS axis_value, method, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) AS n FROM sweep GROUP BY axis, method
UNION ALL SELECT 'setting', CAST(setting AS VARCHAR), method, round(avg(value), 9), round(stddev_pop(value), 9), count(*) FROM sweep GROUP BY setting, method""",
)
def axis_statistics(spark, sf):
    return rounded(sweep.axis_stats(order_sweep(spark, sf), ["axis", "setting"]), 9)


@register("cross_tab", f"WITH {SWEEP_SQL} SELECT axis, seed, method, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) AS n FROM sweep GROUP BY 1, 2, 3")
def cross_tab(spark, sf):
    return rounded(sweep.cross_tab(order_sweep(spark, sf), "axis", "seed"), 9)


@register(
    "phase_diagram",
    f"WITH {SWEEP_SQL} SELECT setting, " + ", ".join(f"coalesce(max_by(value, seed) FILTER (WHERE axis = {a}), CAST('nan' AS DOUBLE)) AS c{a}" for a in range(6)) + " FROM sweep WHERE method = 'NO' GROUP BY setting",
)
def phase_diagram(spark, sf):
    return sweep.phase_diagram(order_sweep(spark, sf).where("method = 'NO'"), "setting", "axis", list(range(6)), "seed")


@register("fixed_columns", f"WITH {SWEEP_SQL}, s AS (SELECT * FROM sweep WHERE method = 'NO' AND seed = 1) " + " UNION ALL ".join(f"SELECT '{c}' AS name, min(CAST({c} AS VARCHAR)) AS value FROM s HAVING count(DISTINCT {c}) = 1" for c in ("method", "axis", "setting", "seed")))
def fixed_columns(spark, sf):
    return sweep.fixed_columns(order_sweep(spark, sf).where("method = 'NO' AND seed = 1"), ["method", "axis", "setting", "seed"])


@register(
    "stability_table",
    f"""WITH {SWEEP_SQL}, q AS (SELECT method, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM sweep GROUP BY 1)
SELECT method, round(mean, 6) AS mean, round(std, 6) AS std, round(q25, 6) AS q25, round(q75, 6) AS q75,
  round((SELECT avg(value) FROM sweep s WHERE s.method = q.method AND s.value <= q.q25), 6) AS worst_quarter FROM q""",
)
def stability(spark, sf):
    return rounded(sweep.stability(order_sweep(spark, sf)))


@register(
    "mean_ranks",
    f"""WITH {SWEEP_SQL}, r AS (SELECT method, row_number() OVER (PARTITION BY axis, setting, seed ORDER BY value DESC NULLS LAST, method) AS rank FROM sweep)
SELECT method, round(avg(rank), 6) AS mean_rank, count(*) AS settings FROM r GROUP BY method""",
)
def mean_ranks(spark, sf):
    return rounded(sweep.mean_ranks(order_sweep(spark, sf), SETTING))


@register(
    "win_rates",
    f"""WITH {SWEEP_SQL}, r AS (SELECT method, CASE WHEN value = max(value) OVER (PARTITION BY axis, setting, seed) THEN 1.0 ELSE 0.0 END AS win FROM sweep)
SELECT method, round(avg(win), 6) AS win_rate FROM r GROUP BY method""",
)
def win_rates(spark, sf):
    return rounded(sweep.win_rates(order_sweep(spark, sf), SETTING))


@register(
    "best_per_column",
    f"""WITH {SWEEP_SQL}, r AS (SELECT axis, method, value, row_number() OVER (PARTITION BY axis ORDER BY value DESC, method) AS nth FROM (SELECT axis, method, round(avg(value), 6) AS value FROM sweep GROUP BY 1, 2))
SELECT axis, method, value FROM r WHERE nth = 1""",
)
def best_per_column(spark, sf):
    by = order_sweep(spark, sf).groupBy("axis", "method").agg(F.round(F.avg("value"), 6).alias("value"))
    return sweep.best_per(by, ["axis"])


@register(
    "win_conditions",
    f"""WITH {SWEEP_SQL}, m AS (SELECT axis, method, avg(value) AS mean FROM sweep GROUP BY 1, 2)
SELECT m.axis, m.method AS rival, round(o.mean - m.mean, 6) AS gap FROM m JOIN m o ON o.axis = m.axis AND o.method = 'NO' WHERE m.method <> 'NO' AND abs(o.mean - m.mean) > 0.0005""",
)
def win_conditions(spark, sf):
    return rounded(sweep.win_conditions(order_sweep(spark, sf), "axis", "NO", least=0.0005))


PAIRS_SQL = f"""WITH {SWEEP_SQL}, d AS (SELECT a.value - b.value AS d FROM sweep a JOIN sweep b USING (axis, setting, seed) WHERE a.method = 'AF' AND b.method = 'RF')"""


@register(
    "paired_summary",
    PAIRS_SQL
    + """ SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(avg(d) - 1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS low,
  round(avg(d) + 1.96 * stddev_pop(d) / sqrt(count(*)), 6) AS high, round(avg(d) / stddev_pop(d), 6) AS effect, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM d HAVING count(*) >= 5""",
)
def paired_summary(spark, sf):
    return rounded(sweep.paired_summary(order_sweep(spark, sf), "AF", "RF", SETTING))


@register(
    "signed_rank_sums",
    PAIRS_SQL
    + """, r AS (SELECT round(d, 9) AS d FROM d WHERE round(d, 9) <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM r)
SELECT sum(rank) FILTER (WHERE d > 0) AS plus, sum(rank) FILTER (WHERE d < 0) AS minus FROM k""",
)
def signed_ranks(spark, sf):
    return sweep.signed_ranks(order_sweep(spark, sf), "AF", "RF", SETTING)


@register("paired_tests")
def paired_tests(spark, sf):
    return rounded(sweep.paired_test(order_sweep(spark, sf), [("AF", "RF"), ("AF", "NO")], SETTING))


@register(
    "advantage_map",
    f"""WITH {SWEEP_SQL} SELECT round(CAST(axis AS DOUBLE), 6) AS axis, round(CAST(seed AS DOUBLE), 6) AS seed, round(avg(value) FILTER (WHERE method = 'AF') - avg(value) FILTER (WHERE method = 'RF'), 9) AS advantage
FROM sweep GROUP BY 1, 2""",
)
def advantage(spark, sf):
    return rounded(sweep.advantage(order_sweep(spark, sf), "AF", "RF", "axis", "seed"), 9)


@register(
    "seed_summary",
    f"""WITH {SWEEP_SQL}, b AS (SELECT method, seed, avg(value) AS v FROM sweep GROUP BY 1, 2)
SELECT method, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n FROM b GROUP BY method""",
)
def seed_summary(spark, sf):
    return rounded(sweep.seed_summary(order_sweep(spark, sf)))


@register(
    "accepted_candidates",
    f"""WITH {BUDGET_SQL}, base AS (SELECT federation_every, total_bytes AS b, accuracy_auc AS a FROM budget WHERE method = '1-URGENT')
SELECT method, federation_every, total_bytes <= 2.5 * b AND ((accuracy_auc >= a - 1e-6 AND total_bytes <= b + 1e-6) OR (accuracy_auc >= a + 0.01 AND total_bytes <= 1.1 * b)) AS accepted
FROM budget JOIN base USING (federation_every)""",
)
def accepted(spark, sf):
    points = order_budget(spark, sf)
    base = points.where("method = '1-URGENT'").select("federation_every", F.col("total_bytes").alias("b"), F.col("accuracy_auc").alias("a"))
    return points.join(base, "federation_every").select("method", "federation_every", sweep.accept_candidate(F.col("accuracy_auc"), F.col("total_bytes"), F.col("a"), F.col("b")).alias("accepted"))


from driftlake.plans import catalog_models, catalog_pools  # noqa: E402,F401  registers the rest
