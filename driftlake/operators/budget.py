"""Accuracy curves, drift recovery and communication budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_curve(grid: DataFrame) -> DataFrame:
    return grid.groupBy("t").agg(F.avg("acc").alias("acc"))


def accuracy_auc(grid: DataFrame) -> DataFrame:
    """Trapezoid under the mean curve, unit spacing. The trapezoid is a weighted sum
    over steps (ends count half), so no ordered window over all steps is needed."""
    curve = mean_curve(grid)
    total = F.sum("acc") - (F.min_by("acc", "t") + F.max_by("acc", "t")) / 2
    return curve.agg(F.when(F.count("*") > 1, total).otherwise(0.0).alias("auc"), F.count("*").alias("steps"))


def budget_score(auc: Column, total_bytes: Column) -> Column:
    """AUC a byte; an error where no bytes were sent."""
    return F.when(total_bytes > 0, auc / total_bytes).otherwise(F.raise_error(F.lit("total bytes must be above 0")).cast("double"))


def model_bytes(params: DataFrame, keys: list[str], bits: int = 32) -> DataFrame:
    if bits <= 0:
        raise ValueError("bits must be positive")
    return params.groupBy(*keys).agg((F.count("*") * bits / 8).alias("bytes"))


def fingerprint_bytes(n_features: Column, n_classes: Column, bits: int = 32, global_mean: bool = True) -> Column:
    if bits <= 0:
        raise ValueError("bits must be positive")
    return (n_classes + n_classes * n_features + (n_features if global_mean else F.lit(0))) * bits / 8


def fedavg_bytes(clients: Column, steps: Column, size: Column, bits: int = 32) -> Column:
    return steps * clients * 2 * size * bits / 8


def dips(grid: DataFrame, window: int = 3, level: float = 0.95) -> DataFrame:
    """For each drift (client, t) but at the last step: the dip of the mean curve and the steps to recover.

    Curve statistics are made once a step and joined to the drifts by step."""
    was = F.lag("gt").over(Window.partitionBy("client").orderBy("t"))
    drifts = grid.withColumn("was", was).where("gt <> was").select("client", "t")
    curve = mean_curve(grid)
    # one row a step: the curve is as long as the time axis, not as the data
    ahead = Window.orderBy("t").rowsBetween(0, window - 1)
    far = Window.orderBy("t").rowsBetween(0, 2 * window - 1)
    stats = curve.select(
        "t",
        F.lag("acc").over(Window.orderBy("t")).alias("pre"),
        F.min("acc").over(ahead).alias("low"),
        F.collect_list("acc").over(far).alias("next"),
        F.lead("t").over(Window.orderBy("t")).alias("later"),
    ).where("later is not null and pre is not null")
    first = F.array_position(F.transform("next", lambda a: a >= level * F.col("pre")), True) - 1
    stats = stats.select("t", F.greatest(F.col("pre") - F.col("low"), F.lit(0.0)).alias("dip"), F.when(first >= 0, first).otherwise(F.lit(2 * window)).cast("long").alias("recovery"))
    return drifts.join(stats, "t").select("client", "t", "dip", "recovery")


def worst_dip(grid: DataFrame, window: int = 3) -> DataFrame:
    found = dips(grid, window)
    return found.agg(F.coalesce(F.greatest(F.max("dip"), F.lit(0.0)), F.lit(0.0)).alias("worst_dip"), F.coalesce(F.max("recovery"), F.lit(0).cast("long")).alias("worst_recovery"))


#: Ordered passes over a whole column are cut into about this many ranges.
RANGES = 64


def in_ranges(rows: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``: numbers of consecutive ranges of a column, of about equal size.

    Their borders are approximate quantiles, at most ``ranges`` numbers; only balance depends on them."""
    borders = sorted(set(rows.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.002)))
    if not borders:
        return rows.withColumn("_range", F.lit(0))
    return rows.withColumn("_range", F.size(F.filter(F.array(*[F.lit(float(b)) for b in borders]), lambda b: b < F.col(column))))


def pareto(points: DataFrame) -> DataFrame:
    """Points (…, total_bytes, accuracy_auc) that no other point beats.

    A sweep from cheap to dear keeps the running best, so no pair is compared: a point stays if its
    score is above all cheaper points' and the best among its equals in cost. The sweep runs in
    ranges of cost; the best of the cheaper ranges, one row a range, is joined to each."""
    best = in_ranges(points.groupBy("total_bytes").agg(F.max("accuracy_auc").alias("top")), "total_bytes")
    tops = best.groupBy("_range").agg(F.max("top").alias("top"))
    cheaper = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    tops = tops.select("_range", F.max("top").over(cheaper).alias("below"))
    before = Window.partitionBy("_range").orderBy("total_bytes").rowsBetween(Window.unboundedPreceding, -1)
    swept = best.withColumn("so_far", F.max("top").over(before)).join(F.broadcast(tops), "_range")
    so_far = F.greatest("so_far", "below")
    front = swept.where(so_far.isNull() | (F.col("top") > so_far)).select("total_bytes", F.col("top").alias("accuracy_auc"))
    return points.join(front, ["total_bytes", "accuracy_auc"], "left_semi")


def crossovers(points: DataFrame, first: str, second: str, cells: int = 10) -> DataFrame:
    """(total_bytes, accuracy_auc) at which two methods' interpolated curves cross.

    Both are interpolated on ``cells`` times as many equal steps over their common range as the
    longer curve has points; a cell with opposite signs gives the crossing of its two lines, and a
    step at which they are equal gives itself (but the last). Every piece of a curve names the
    steps it covers, and steps meet their next ones by number, so no rows are compared by range."""
    two = points.where(F.col("method").isin(first, second)).select("method", F.col("total_bytes").cast("double").alias("x"), F.col("accuracy_auc").cast("double").alias("y"))
    ends = two.groupBy("method").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).where("n > 1")
    ends = ends.agg(F.count("*").alias("methods"), F.max("lo").alias("lo"), F.min("hi").alias("hi"), (F.max("n") * cells).alias("steps")).where("methods = 2 and lo < hi")
    w = Window.partitionBy("method").orderBy("x")
    pieces = two.select("method", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 > x").join(F.broadcast(ends), (F.col("x2") >= F.col("lo")) & (F.col("x") <= F.col("hi")))  # one row
    wide = (F.col("hi") - F.col("lo")) / (F.col("steps") - 1)
    number = lambda x, d: F.least(F.greatest(F.floor((x - F.col("lo")) / wide) + d, F.lit(0)), F.col("steps") - 1).cast("long")
    at = pieces.withColumn("i", F.explode(F.sequence(number(F.col("x"), -1), number(F.col("x2"), 1))))
    at = at.withColumn("g", F.when(F.col("i") == F.col("steps") - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * wide)).where("g >= x and g <= x2")
    value = F.col("y") + (F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x")) * (F.col("g") - F.col("x"))
    curves = at.groupBy("i", "steps").agg(F.max("g").alias("g"), F.max(F.when(F.col("method") == first, value)).alias("a"), F.max(F.when(F.col("method") == second, value)).alias("b"))
    curves = curves.select("i", "steps", "g", "a", (F.col("a") - F.col("b")).alias("d"))
    later = curves.select((F.col("i") - 1).alias("i"), F.col("g").alias("g2"), F.col("a").alias("a2"), F.col("d").alias("d2"))
    both = curves.join(later, "i").withColumn("t", F.when(F.col("d") == 0, 0.0).when(F.col("d") * F.col("d2") < 0, F.col("d") / (F.col("d") - F.col("d2")))).where("t is not null")
    return both.select((F.col("g") + F.col("t") * (F.col("g2") - F.col("g"))).alias("total_bytes"), (F.col("a") + F.col("t") * (F.col("a2") - F.col("a"))).alias("accuracy_auc"))


def prototype_bytes(prototypes: DataFrame, keys: list[str], bits: int = 32) -> DataFrame:
    """(keys, bytes) for class means (keys, …, mean): what sending them takes."""
    if bits <= 0:
        raise ValueError("bits must be positive")
    return prototypes.groupBy(*keys).agg((F.sum(F.size("mean")) * bits / 8).alias("bytes"))


def frontier_gate(points: DataFrame, ours: list[str], leaders: list[str]) -> DataFrame:
    """One row: how many of our points no point beats, the leaders' left aside, which method has the
    best score a byte, and whether the gate passes by either."""
    among = points.where(~F.col("method").isin(*leaders))
    kept = pareto(among).where(F.col("method").isin(*ours)).agg(F.count("*").alias("not_beaten"))
    ratio = F.struct((F.col("accuracy_auc") / F.col("total_bytes")).alias("score"), F.col("method").alias("method"))
    best = points.where("total_bytes > 0").agg(F.max(ratio).alias("best"))
    both = kept.crossJoin(best)  # one row each
    return both.select("not_beaten", F.col("best.method").alias("best_method"), F.coalesce((F.col("not_beaten") > 0) | F.col("best.method").isin(*ours), F.lit(False)).alias("passed"))


def identity_gate(summary: DataFrame, ours: str, other: str, metric: str) -> DataFrame:
    """One row: both methods' means of a metric, their difference, and whether ours is at least as good; not passed where one is missing."""
    mean = lambda m: F.avg(F.when(F.col("method") == m, F.col(metric)))
    return summary.agg(mean(ours).alias("ours"), mean(other).alias("other")).select("ours", "other", (F.col("ours") - F.col("other")).alias("gap"), F.coalesce(F.col("ours") >= F.col("other"), F.lit(False)).alias("passed"))
