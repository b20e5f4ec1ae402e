"""Identity, switching and group metrics of a grid (client, t, gt, pred[, acc]).

Every metric is one or two aggregations with partial aggregation on the map side.
The one thing gathered in a task is the contingency of a run, whose size is bounded
by the numbers of concepts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.operators.solvers import best_mapping, greedy_mapping


def by_client():
    """A client's steps in order. (Windows need a session, so none is made on import.)"""
    return Window.partitionBy("client").orderBy("t")


def contingency(grid: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of (pred, gt), without the zero cells."""
    return grid.groupBy(*keys, "pred", "gt").agg(F.count("*").alias("n"))


def mapping(grid: DataFrame, keys: tuple[str, ...] = (), greedy: bool = False) -> DataFrame:
    """(pred, aligned): the matching of predicted to true ids with most agreement, -1 for ids left over.

    Greedy takes the largest cell again and again instead."""
    solve = greedy_mapping if greedy else best_mapping
    schema = "".join(f"{k} {grid.schema[k].dataType.simpleString()}, " for k in keys) + "pred long, aligned long"

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        wide = cells.pivot_table(index="pred", columns="gt", values="n", aggfunc="sum", fill_value=0)
        at = solve(wide.to_numpy())
        out = pd.DataFrame({"pred": wide.index, "aligned": [wide.columns[j] if j >= 0 else -1 for j in at]})
        for k in keys:
            out[k] = cells[k].iloc[0]
        return out[[*keys, "pred", "aligned"]]

    return contingency(grid, keys).groupBy(*keys).applyInPandas(run, schema)


def align(grid: DataFrame, keys: tuple[str, ...] = (), greedy: bool = False) -> DataFrame:
    """The grid with ``aligned``. The mapping has a row per predicted id; AQE broadcasts it if it is small."""
    return grid.join(mapping(grid, keys, greedy), [*keys, "pred"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(-1)))


def re_id_accuracy(grid: DataFrame) -> DataFrame:
    """Aligned accuracy over all, by client and by step, in one pass by grouping sets."""
    hit = (F.col("aligned") == F.col("gt")).cast("double")
    both = align(grid).withColumn("hit", hit)
    sets = both.groupingSets([[], ["client"], ["t"]], "client", "t")
    return sets.agg(F.grouping_id().alias("level"), F.avg("hit").alias("accuracy"), F.count("*").alias("cells")).select("level", "client", "t", "accuracy", "cells")


def overall(grid: DataFrame) -> DataFrame:
    """Re-ID accuracy, wrong reuse and clustering error of the whole grid."""
    hit = F.avg((F.col("aligned") == F.col("gt")).cast("double"))
    return align(grid).agg(hit.alias("re_id"), (1 - hit).alias("wrong_reuse"), F.count("*").alias("cells"))


def tracking_accuracy(grid: DataFrame) -> DataFrame:
    return align(grid, greedy=True).agg(F.avg((F.col("aligned") == F.col("gt")).cast("double")).alias("tracking_accuracy"))


def drift_points(grid: DataFrame) -> DataFrame:
    """Cells whose concept differs from the client's step before, with both concepts."""
    before = F.lag("gt").over(by_client())
    return grid.withColumn("was", before).where("gt <> was").select("client", "t", F.col("was").alias("from_concept"), F.col("gt").alias("to_concept"))


def switch_rate(grid: DataFrame, column: str = "pred") -> DataFrame:
    """Changes among transitions; 0 without transitions."""
    moved = grid.withColumn("was", F.lag(column).over(by_client())).where("was is not null")
    return moved.agg(F.coalesce(F.avg((F.col(column) != F.col("was")).cast("double")), F.lit(0.0)).alias("switch_rate"), F.count("*").alias("transitions"))


def group_sizes(grid: DataFrame, column: str = "pred") -> DataFrame:
    return grid.groupBy("t", column).agg(F.count("*").alias("size"))


def group_metrics(grid: DataFrame, column: str = "pred") -> DataFrame:
    """Mean group size, share of groups of one, share of cells alone, and size statistics."""
    sizes = group_sizes(grid, column)
    alone = F.sum((F.col("size") == 1).cast("long"))
    return sizes.agg(
        F.avg("size").alias("clients_per_concept"),
        (alone / F.count("*")).alias("singleton_groups"),
        (alone / F.sum("size")).alias("singleton_cells"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
    )


def step_groups(grid: DataFrame, column: str = "gt") -> DataFrame:
    """By step: active concepts and the smallest, mean and largest group."""
    return group_sizes(grid, column).groupBy("t").agg(F.count("*").alias("active"), F.min("size").alias("least"), F.avg("size").alias("mean"), F.max("size").alias("most"))


def memory_reuse(grid: DataFrame) -> DataFrame:
    """Cells after the first step whose aligned concept the client has had before, among K(T-1)."""
    seen = F.row_number().over(Window.partitionBy("client", "aligned").orderBy("t")) > 1
    marked = align(grid).select("client", "t", seen.cast("long").alias("again"))
    later = F.count("*") - F.countDistinct("client")
    return marked.agg((F.sum("again") / F.when(later > 0, later)).alias("reuse_rate"), F.sum("again").alias("reused"))


def recurrence(grid: DataFrame) -> DataFrame:
    """Share of cells whose concept the client has had before, among all cells."""
    seen = F.row_number().over(Window.partitionBy("client", "gt").orderBy("t")) > 1
    return grid.select(seen.cast("double").alias("again")).agg(F.avg("again").alias("recurrence_ratio"))


def recurrence_events(grid: DataFrame) -> DataFrame:
    """(client, t, before, concept): the concept comes back after others lay between."""
    before = F.lag("t").over(Window.partitionBy("client", "gt").orderBy("t"))
    return grid.withColumn("before", before).where("t - before > 1").select("client", "t", "before", F.col("gt").alias("concept"))


def knowledge_kept(grid: DataFrame, least: float = 0.05) -> DataFrame:
    """Mean ratio of accuracy at a recurrence to that at the earlier visit; 1 without events."""
    w = Window.partitionBy("client", "gt").orderBy("t")
    rows = grid.select("t", F.lag("t").over(w).alias("before"), "acc", F.lag("acc").over(w).alias("was"))
    rows = rows.where((F.col("t") - F.col("before") > 1) & (F.col("was") > least))
    return rows.agg(F.coalesce(F.avg(F.col("acc") / F.col("was")), F.lit(1.0)).alias("preservation"), F.count("*").alias("events"))


def recovery_gap(grid: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean accuracy over a baseline's at recurrence events; 0 without events."""
    events = recurrence_events(grid).select("client", "t")
    both = events.join(grid.select("client", "t", "acc"), ["client", "t"]).join(baseline.select("client", "t", F.col("acc").alias("base")), ["client", "t"])
    return both.agg(F.coalesce(F.avg(F.col("acc") - F.col("base")), F.lit(0.0)).alias("recovery_gap"), F.count("*").alias("events"))


def time_to_recovery(grid: DataFrame, share: float = 0.8, longest: int = 5) -> DataFrame:
    """By switch: steps until accuracy reaches a share of the client's best on the concept, while the concept lasts."""
    peak = F.max("acc").over(Window.partitionBy("client", "gt"))
    run = F.sum(F.coalesce((F.col("gt") != F.lag("gt").over(by_client())).cast("long"), F.lit(0))).over(by_client())
    rows = grid.select("client", "t", "gt", "acc", peak.alias("peak"), run.alias("run"))
    since = F.col("t") - F.min("t").over(Window.partitionBy("client", "run"))
    rows = rows.withColumn("dt", since).where((F.col("run") > 0) & (F.col("dt") <= longest))
    done = F.min(F.when(F.col("acc") >= share * F.col("peak"), F.col("dt")))
    return rows.groupBy("client", "run").agg(F.min("t").alias("t"), F.coalesce(done, F.lit(longest).cast("long")).alias("steps")).select("client", "t", "steps")


def hard_entropy(grid: DataFrame, n: int | None = None) -> DataFrame:
    """By step: entropy of the predicted ids on the support 0..n-1; ids outside are dropped,
    empty cells count with the clipped probability 1e-12."""
    n_col = F.lit(n) if n is not None else None
    if n_col is None:
        top = grid.agg((F.max("gt") + 1).alias("n"))
        grid = grid.crossJoin(F.broadcast(top))  # one row
    else:
        grid = grid.withColumn("n", n_col)
    counts = grid.where((F.col("pred") >= 0) & (F.col("pred") < F.col("n"))).groupBy("t", "pred").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    # with only sums over the ids: -sum p ln p = ln S - sum(c ln c) / S
    entropy = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    empty = (F.max("n") - F.count("*")) * F.lit(-1e-12 * math.log(1e-12))
    return counts.groupBy("t").agg((entropy + empty).alias("entropy"))


def soft_entropy(soft: DataFrame) -> DataFrame:
    """Mean entropy of the cells (client, t, concept, p) that have mass; of all if none has."""
    p = F.greatest("p", F.lit(1e-12))
    cells = soft.groupBy("client", "t").agg(F.sum(-p * F.log(p)).alias("h"), F.sum("p").alias("mass"))
    full = F.avg(F.when(F.col("mass") > 1e-12, F.col("h")))
    return cells.agg(F.coalesce(full, F.avg("h")).alias("soft_entropy"))


def routing_consistency(soft: DataFrame) -> DataFrame:
    """1 minus the mean total variation between a client's consecutive steps; 1 without transitions.

    Sparse cells are compared without making them dense: |p - q| sums to
    sum(p) + sum(q) - 2 sum(min(p, q)), and only concepts in both steps have a minimum."""
    # dealt out by client once; a step's cells are one row, its predecessor's are beside it
    cells = soft.repartition("client").groupBy("client", "t").agg(F.sum("p").alias("mass"), F.collect_list(F.struct("concept", "p")).alias("cells"))
    w = Window.partitionBy("client").orderBy("t")
    pairs = cells.select("mass", "cells", F.lag("mass").over(w).alias("mass0"), F.lag("cells").over(w).alias("cells0")).where("cells0 is not null")
    was = lambda c: F.coalesce(F.get(F.filter("cells0", lambda o: o["concept"] == c["concept"]), F.lit(0))["p"], F.lit(0.0))
    least = F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.least(c["p"].cast("double"), was(c).cast("double")))
    tv = (F.col("mass") + F.col("mass0") - 2 * least) / 2
    return pairs.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tv)).alias("tv")).agg((1 - F.coalesce(F.avg("tv"), F.lit(0.0))).alias("routing_consistency"))


def carry_forward(grid: DataFrame, every: int) -> DataFrame:
    """Predictions of federation steps only, carried forward to the steps between."""
    at = F.when((F.col("t") + 1) % every == 0, F.col("pred"))
    return grid.select("client", "t", F.last(at, ignorenulls=True).over(by_client().rowsBetween(Window.unboundedPreceding, 0)).alias("pred"))


def running_accuracy(grid: DataFrame, fading: float = 1.0) -> DataFrame:
    """Accuracy so far at each step of a client; with fading, older steps weigh less."""
    so_far = by_client().rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("pred") == F.col("gt")).cast("double")
    if fading == 1.0:
        return grid.select("client", "t", F.avg(hit).over(so_far).alias("accuracy"))
    if not 0 < fading < 1:
        raise ValueError("fading must be in (0, 1]")
    # the faded sum at step i is fading^i times a running sum of hit / fading^i, made in blocks in which the powers stay
    # in range; the blocks before, of which one row each is kept, fade on as a whole
    size = max(1, min(1024, int(-200 / math.log10(fading))))
    nth = F.row_number().over(by_client()) - 1
    rows = grid.select("client", "t", hit.alias("hit"), nth.alias("i")).withColumn("block", F.floor(F.col("i") / size)).withColumn("k", F.col("i") % size)
    inside = Window.partitionBy("client", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda c: F.pow(F.lit(fading), c)
    rows = rows.withColumn("own", F.sum(F.col("hit") / power(F.col("k"))).over(inside) * power(F.col("k")))
    last = rows.groupBy("client", "block").agg(F.max_by("own", "i").alias("end"))
    earlier = Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.aggregate(F.collect_list("end").over(earlier), F.lit(0.0), lambda a, v: a * fading**size + v)
    rows = rows.join(last.select("client", "block", carried.alias("before")), ["client", "block"])
    faded = F.col("own") + F.col("before") * power(F.col("k") + 1)
    return rows.select("client", "t", (faded * (1 - fading) / (1 - power(F.col("i") + 1))).alias("accuracy"))


def all_metrics(grid: DataFrame, total_bytes: float | None = None, identity_capable: bool = True) -> DataFrame:
    """All metrics of a run in one row; a method that infers no identities has null for those that need them."""
    from driftlake.operators import budget
    from driftlake.sources.shared import stored

    # every part reads the grid again; it is made once
    grid = stored(grid.select("client", "t", "gt", "pred", "acc"), "metrics-grid")
    names = ("re_id", "assignment_entropy", "switch_rate", "clients_per_concept", "singleton_groups", "reuse_rate", "routing_consistency", "wrong_reuse")
    last = grid.agg(F.max("t").alias("last"))
    final = grid.join(F.broadcast(last), F.col("t") == F.col("last")).agg(F.avg("acc").alias("final_accuracy"))  # one row
    rows = budget.accuracy_auc(grid).select("auc").crossJoin(budget.worst_dip(grid)).crossJoin(final)  # one row each, as below
    score = budget.budget_score(F.col("auc"), F.lit(total_bytes)) if total_bytes is not None else F.lit(None).cast("double")
    rows = rows.select("final_accuracy", F.col("auc").alias("accuracy_auc"), "worst_dip", "worst_recovery", score.alias("budget_score"))
    if not identity_capable:
        return rows.select(*[F.lit(None).cast("double").alias(n) for n in names], *rows.columns)
    hard = grid.select("client", "t", F.col("pred").alias("concept"), F.lit(1.0).alias("p"))
    parts = [
        overall(grid).select("re_id", "wrong_reuse"), hard_entropy(grid).agg(F.avg("entropy").alias("assignment_entropy")), switch_rate(grid).select("switch_rate"),
        group_metrics(grid).select("clients_per_concept", "singleton_groups"), memory_reuse(grid).select("reuse_rate"), routing_consistency(hard),
    ]
    for part in parts:
        rows = rows.crossJoin(part)
    return rows.select(*names, "final_accuracy", "accuracy_auc", "worst_dip", "worst_recovery", "budget_score")


def novelty_streaks(grid: DataFrame, is_novel: Column) -> DataFrame:
    """Length of the run of novel steps that ends at each step (gaps and islands)."""
    island = F.sum((~is_novel).cast("long")).over(by_client().rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.select("client", "t", is_novel.alias("novel"), island.alias("island"))
    w = Window.partitionBy("client", "island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("client", "t", F.sum(F.col("novel").cast("long")).over(w).alias("streak"))


def forgetting(grid: DataFrame) -> DataFrame:
    """Over concepts seen twice or more by the mean curve: best before the last minus last, and last minus first."""
    seen = grid.groupBy("gt", "t").agg(F.avg("acc").alias("a"))
    w = Window.partitionBy("gt").orderBy("t")
    rows = seen.select("gt", "t", "a", F.row_number().over(w.orderBy(F.desc("t"))).alias("back"))
    by = rows.groupBy("gt").agg(F.max(F.when(F.col("back") > 1, F.col("a"))).alias("best"), F.max_by("a", "t").alias("last"), F.min_by("a", "t").alias("first"), F.count("*").alias("n"))
    by = by.where("n >= 2")
    return by.agg(F.coalesce(F.avg(F.col("best") - F.col("last")), F.lit(0.0)).alias("forgetting"), F.coalesce(F.avg(F.col("last") - F.col("first")), F.lit(0.0)).alias("backward_transfer"))


def detection_metrics(drifts: DataFrame, fired: DataFrame) -> DataFrame:
    """Detection metrics from true (client, t) and fired (client, t) points.

    ``detection_rate`` and ``false_alarm_rate`` compare the numbers of fired and true points (1 without
    true ones; the excess of fired ones, 0 without any); ``hit_rate`` and ``miss_share`` compare the
    points themselves. ``identification_accuracy`` is the share of fired points that are true,
    ``mean_delay`` the mean steps from a true point to the client's next fired one (0 without any)."""
    both = drifts.select("client", "t", F.lit(1).alias("is_true"), F.lit(0).alias("is_fired")).unionByName(fired.select("client", "t", F.lit(0).alias("is_true"), F.lit(1).alias("is_fired")))
    cells = both.groupBy("client", "t").agg(F.max("is_true").alias("d"), F.max("is_fired").alias("f"))
    ahead = Window.partitionBy("client").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    delay = F.min(F.when(F.col("f") == 1, F.col("t"))).over(ahead) - F.col("t")
    cells = cells.withColumn("delay", F.when(F.col("d") == 1, delay))
    true, found, hit = F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.col("d") * F.col("f")), F.lit(0))
    return cells.agg(
        F.when(true > 0, found / true).otherwise(1.0).alias("detection_rate"),
        F.when(found > 0, F.greatest(found - true, F.lit(0)) / found).otherwise(0.0).alias("false_alarm_rate"),
        F.when(true > 0, hit / true).otherwise(1.0).alias("hit_rate"),
        F.when(found > 0, (found - hit) / found).otherwise(0.0).alias("miss_share"),
        F.when(found > 0, hit / found).otherwise(0.0).alias("identification_accuracy"),
        F.coalesce(F.avg("delay"), F.lit(0.0)).alias("mean_delay"),
        true.alias("true_drifts"),
        found.alias("detections"),
    )


def round_summary(grid: DataFrame, every: int) -> DataFrame:
    """By federation round (a tumbling window of steps): cells, switches, novel ids and mean accuracy."""
    was = F.lag("pred").over(by_client())
    first = F.row_number().over(Window.partitionBy("client", "pred").orderBy("t")) == 1
    rows = grid.select(F.floor(F.col("t") / every).alias("round"), "acc", (F.col("pred") != was).cast("long").alias("switch"), first.cast("long").alias("novel"))
    return rows.groupBy("round").agg(F.count("*").alias("cells"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches"), F.sum("novel").alias("novel"), F.avg("acc").alias("accuracy"))


def resolve_merges(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Follows (old, new) renamings to their end for each id, however long the chain; a cycle is an error.

    Each round doubles the way a renaming spans, so rounds are the logarithm of the longest chain.
    Rounds are stored in the folder in ``spark.checkpoint.dir``."""
    links = pairs.where("old <> new").select("old", "new").checkpoint()
    most = links.count().bit_length()
    for done in range(most + 1):
        after = links.select(F.col("old").alias("new"), F.col("new").alias("end"))
        step = links.join(after, "new", "left")
        if not step.where("end is not null").limit(1).count():
            break
        if done == most:
            raise ValueError("the renamings hold a cycle")
        links = step.select("old", F.coalesce("end", "new").alias("new")).checkpoint()
    return ids.join(links, ids["id"] == links["old"], "left").select("id", F.coalesce("new", "id").alias("root"))


def accuracy_matrix(grid: DataFrame) -> np.ndarray:
    """Dense (client x t) accuracy, for small grids and plots."""
    rows = grid.select("client", "t", "acc").toPandas()
    return rows.pivot_table(index="client", columns="t", values="acc").to_numpy()
