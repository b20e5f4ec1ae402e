"""Rank stability, power and group tests of methods in a sweep.

Resampling is a Poisson bootstrap: in each replicate a unit counts as often as a hash of
(seed, replicate, unit) says. Units that share a key count alike for all methods, so
comparisons stay paired; sums of all replicates are one aggregation with partial sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.hashing import hash_unit, poisson
from driftlake.operators.sweep import pairs


def replicates(rows: DataFrame, units: list[str], n: int, seed: int = 42) -> DataFrame:
    """Each row with ``replicate`` (0 to n - 1) and ``times``, above 0."""
    out = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("times", poisson(hash_unit(F.lit(seed), "replicate", *units))).where("times > 0")


def rank_stability(sweep: DataFrame, units: list[str], n: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """By method: mean over all units, interval of the replicates' means, mean rank, shares of replicates with
    the first rank (largest mean) and with the rank that all units give. Ties share the smaller rank."""
    whole = sweep.groupBy("method").agg(F.avg("value").alias("mean")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))  # one row a method
    means = replicates(sweep, units, n, seed).groupBy("method", "replicate").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("m"))
    means = means.withColumn("r", F.rank().over(Window.partitionBy("replicate").orderBy(F.desc("m"))))
    low = (1 - level) / 2
    by = means.join(whole, "method").groupBy("method", "mean", "rank").agg(
        F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(1 - low)).alias("high"), F.avg("r").alias("mean_rank"),
        F.avg((F.col("r") == 1).cast("double")).alias("first"), F.avg((F.col("r") == F.col("rank")).cast("double")).alias("same"),
    )
    return by.select("method", "mean", "low", "high", "rank", "mean_rank", "first", "same")


def paired_power(sweep: DataFrame, a: str, b: str, keys: list[str], n: int = 200, critical: float = 1.96, seed: int = 42) -> DataFrame:
    """One row (pairs, mean, low, high, power): ``power`` is the share of replicates whose paired t passes ``critical`` in size."""
    d = pairs(sweep, a, b, keys).select(*keys, (F.col("a") - F.col("b")).alias("d"))
    w = F.col("times")
    by = replicates(d, keys, n, seed).groupBy("replicate").agg(F.sum(w).alias("k"), F.sum(w * F.col("d")).alias("s"), F.sum(w * F.col("d") * F.col("d")).alias("q"))
    mean = F.col("s") / F.col("k")
    variance = F.try_divide(F.col("q") - F.col("k") * mean * mean, F.col("k") - 1)
    t = F.when((F.col("k") > 1) & (variance > 0), mean / F.sqrt(variance / F.col("k")))
    one = by.select(mean.alias("m"), (F.abs(t) > critical).alias("passed")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg(F.coalesce("passed", F.lit(False)).cast("double")).alias("power"))
    return d.agg(F.count("*").alias("pairs"), F.avg("d").alias("mean")).crossJoin(one)


def group_tests(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, diff, cohen_d, t, df, f) of each pair of groups of two rows or more: pooled two-sample t, the
    standardised difference, and F of all groups. Groups are reduced to three numbers before they meet.

    Without spread, t and the standardised difference are infinite and F is null."""
    own = rows.groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1")
    inside = F.sum(F.col("v") * (F.col("n") - 1))
    total = own.agg(F.count("*").alias("groups"), F.sum("n").alias("all"), inside.alias("inside"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"))
    f = total.select(F.try_divide(F.col("between") * (F.col("all") - F.col("groups")), F.col("inside") * (F.col("groups") - 1)).alias("f"))
    side = lambda s: own.select(F.col("g").alias(s), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}"), F.col("v").alias(f"v_{s}"))
    both = side("a").join(side("b"), F.col("a") < F.col("b"))
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = (F.col("v_a") * (F.col("n_a") - 1) + F.col("v_b") * (F.col("n_b") - 1)) / df
    diff = F.col("m_a") - F.col("m_b")
    t = F.when(pooled > 0, diff / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).when(diff == 0, 0.0).otherwise(F.signum(diff) * float("inf"))
    d = F.when(pooled > 0, F.abs(diff) / F.sqrt(pooled)).otherwise(F.lit(float("inf")))
    return both.crossJoin(F.broadcast(f)).select("a", "b", diff.alias("diff"), d.alias("cohen_d"), t.alias("t"), df.alias("df"), "f")


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    if math.isnan(t) or math.isinf(t):
        return 0.0 if math.isinf(t) else math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = (1 - x, b, a) if swap else (x, a, b)
    if x <= 0:
        part = 0.0
    else:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
        out = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        part = front * out
    return min(1.0, 1 - part if swap else part)


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds ``p`` and ``p_corrected``, which is p times the number of pairs, 1 at most."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(p=[t_p_value(*x) for x in zip(part["t"], part["df"], strict=True)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tests.schema)
    out = tests.mapInPandas(run, f"{fields}, p double")
    count = tests.agg(F.count("*").alias("_pairs"))
    return out.crossJoin(F.broadcast(count)).withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * F.col("_pairs"))).drop("_pairs")
