"""Sweep analytics: grouped statistics, pivots, ranks, win rates and paired tests.

A sweep is a long table (method, axes…, setting, seed, value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.operators.budget import in_ranges
from driftlake.operators.solvers import wilcoxon_p


def axis_stats(sweep: DataFrame, axes: list[str]) -> DataFrame:
    """Mean, population deviation and count of each method by each axis at once (grouping sets)."""
    sets = [[a, "method"] for a in axes]
    named = F.coalesce(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in axes])
    value = F.coalesce(*[F.when(F.grouping(a) == 0, F.col(a).cast("string")) for a in axes])
    out = sweep.groupingSets(sets, *axes, "method").agg(named.alias("axis_name"), value.alias("axis_value"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    return out.select("axis_name", "axis_value", "method", "mean", "std", "n")


def cross_tab(sweep: DataFrame, first: str, second: str) -> DataFrame:
    return sweep.groupBy(first, second, "method").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def phase_diagram(sweep: DataFrame, row: str, column: str, values: list, order: str) -> DataFrame:
    """Pivot of two axes; of several rows in a cell the last by ``order`` counts, empty cells are NaN."""
    wide = sweep.groupBy(row).pivot(column, values).agg(F.max_by("value", order))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(float("nan"))).alias(f"c{v}") for v in values])


def fixed_columns(sweep: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold one value, with it."""
    one = sweep.agg(*[F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).cast("string").alias(c) for c in columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("name", "value")).where("value is not null")


def stability(sweep: DataFrame) -> DataFrame:
    """By method: mean, deviation, quartiles and the mean of the lowest quarter."""
    q = sweep.groupBy("method").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", 0.25).alias("q25"), F.percentile("value", 0.75).alias("q75"))
    low = sweep.join(q.select("method", "q25"), "method").where("value <= q25").groupBy("method").agg(F.avg("value").alias("worst_quarter"))
    return q.join(low, "method")


def mean_ranks(sweep: DataFrame, setting: list[str], method_order: Column | str = "method") -> DataFrame:
    """Mean position of each method over settings: higher is better, ties by method order, nulls last."""
    w = Window.partitionBy(*setting).orderBy(F.col("value").desc_nulls_last(), method_order)
    return sweep.withColumn("rank", F.row_number().over(w)).groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("settings"))


def win_rates(sweep: DataFrame, setting: list[str]) -> DataFrame:
    """Share of settings in which a method is best; all that tie win."""
    best = F.max("value").over(Window.partitionBy(*setting))
    return sweep.withColumn("win", (F.col("value") == best).cast("double")).groupBy("method").agg(F.avg("win").alias("win_rate"))


def best_per(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The best method of each key; the first by name among equals, NaN and null never."""
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "method")
    return sweep.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("at", F.row_number().over(w)).where("at = 1").select(*keys, "method", "value")


def win_conditions(sweep: DataFrame, axis: str, method: str, rivals: list[str] | None = None, least: float = 0.02) -> DataFrame:
    """Axis values at which a method's mean differs from a rival's by more than ``least``."""
    mean = sweep.groupBy(axis, "method").agg(F.avg("value").alias("mean"))
    own = mean.where(F.col("method") == method).select(axis, F.col("mean").alias("own"))
    others = mean.where(F.col("method") != method)
    if rivals is not None:
        others = others.where(F.col("method").isin(rivals))
    gap = F.col("own") - F.col("mean")
    return others.join(own, axis).where(F.abs(gap) > least).select(axis, F.col("method").alias("rival"), gap.alias("gap"))


def pairs(sweep: DataFrame, a: str, b: str, keys: list[str], order: str = "value") -> DataFrame:
    """Values of two methods at the same keys; of a method's several rows at one key the last by ``order`` counts.

    One aggregation instead of a self join. Rows of a table have no order of their own, so without a
    column that tells it the largest value counts."""
    pick = lambda m: F.max_by(F.when(F.col("method") == m, F.col("value")), F.when(F.col("method") == m, F.col(order)))
    two = sweep.where(F.col("method").isin(a, b)).groupBy(*keys).agg(pick(a).alias("a"), pick(b).alias("b"))
    return two.where("a is not null and b is not null")


def paired_summary(sweep: DataFrame, a: str, b: str, keys: list[str], least: int = 5) -> DataFrame:
    """Pairs, mean difference, its 95 % interval, effect size, win rate and the signed-rank sums."""
    d = pairs(sweep, a, b, keys).select((F.col("a") - F.col("b")).alias("d"))
    base = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.avg((F.col("d") > 0).cast("double")).alias("win_rate")).where(F.col("n") >= least)
    half = 1.96 * F.col("std") / F.sqrt("n")
    return base.select("n", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0).alias("effect"), "win_rate")


def rank_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, plus, minus, ties) of rows (keys, d): signed-rank sums of the differences that are not 0.

    Ranks come from counts by size: those of the smaller ranges of sizes, which are one row a range and
    key, and a running count within a range. ``ties`` is the sum of k^3 - k over groups of k equal sizes."""
    sizes = rows.where("d <> 0").groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    sizes = in_ranges(sizes, "size")
    smaller = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.groupBy(*keys, "_range").agg(F.sum("n").alias("n")).select(*keys, "_range", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*keys, "_range").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(below, [*keys, "_range"])
    rank = F.col("below") + F.col("before") + (F.col("n") + 1) / 2
    ranked = ranked.select(*keys, "n", "up", rank.alias("rank"))
    n = F.col("n").cast("double")
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("minus"), F.sum(n * n * n - n).alias("ties"))


def signed_ranks(sweep: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Sums of the signed ranks of paired differences (a less b), zeros left out and ties sharing their mean rank."""
    rows = pairs(sweep, a, b, keys).select(F.lit(1).alias("_one"), F.round(F.col("a") - F.col("b"), 9).alias("d"))
    return rank_sums(rows, ["_one"]).select("plus", "minus")


def paired_test(sweep: DataFrame, comparisons: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Signed-rank statistic and p for each pair of methods, from rank sums of one row a comparison."""
    frames = [pairs(sweep, a, b, keys).select(F.lit(a).alias("a_method"), F.lit(b).alias("b_method"), (F.col("a") - F.col("b")).alias("d")) for a, b in comparisons]
    rows = reduce(DataFrame.unionByName, frames)
    names = ["a_method", "b_method"]
    sums = rows.groupBy(*names).agg(F.count("*").alias("pairs")).join(rank_sums(rows, names), names, "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, w, ties = part["n"].fillna(0).astype(int), part[["plus", "minus"]].min(axis=1).fillna(0.0), part["ties"].fillna(0.0)
            yield pd.DataFrame({**{k: part[k] for k in names}, "n": part["pairs"], "w": w, "p": [wilcoxon_p(*x) for x in zip(n, w, ties, strict=True)]})

    return sums.mapInPandas(run, "a_method string, b_method string, n long, w double, p double")


def advantage(sweep: DataFrame, a: str, b: str, row: str, column: str, digits: int = 6) -> DataFrame:
    """Cell-wise mean of one method over another's; axes are equal to a tolerance, as rounded keys."""
    keys = [F.round(F.col(c).cast("double"), digits).alias(c) for c in (row, column)]
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("value")))
    return sweep.where(F.col("method").isin(a, b)).groupBy(*keys).agg((of(a) - of(b)).alias("advantage")).where("advantage is not null")


def curve_summary(curves: DataFrame, status: str | None = None) -> DataFrame:
    """(method, t, mean, std, n) over seeds of curves (method, seed, t, value[, status]); runs that aren't ok are left out."""
    rows = curves if status is None else curves.where(F.lower(F.trim(F.col(status))).isin("ok", "success", "completed"))
    by = rows.groupBy("method", "seed", "t").agg(F.avg("value").alias("value"))
    return by.groupBy("method", "t").agg(F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("value")).alias("std"), F.count("*").alias("n"))


def seed_summary(sweep: DataFrame) -> DataFrame:
    """Mean over seeds; a sample deviation only where there are several."""
    by = sweep.groupBy("method", "seed").agg(F.avg("value").alias("value"))
    return by.groupBy("method").agg(F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("value")).alias("std"), F.count("*").alias("n"))


def accept_candidate(auc: Column, cost: Column, base_auc: Column, base_cost: Column) -> Column:
    """A candidate passes if it is no worse in both, or clearly better within a tenth more bytes; never beyond 2.5 times."""
    weak = (auc >= base_auc - 1e-6) & (cost <= base_cost + 1e-6)
    gain = (auc >= base_auc + 0.01) & (cost <= 1.1 * base_cost)
    return (cost <= 2.5 * base_cost) & (weak | gain)
