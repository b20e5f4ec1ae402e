"""Entropic transport over a long cost table (key, i, j, cost, a, b), by alternating aggregations.

Supports needn't fit a row or a task: a scaling round is one aggregation by i and one by j,
each with partial sums, and only the scalings are joined back. Rounds are stored now and then,
which cuts the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.sources.shared import stored

#: Rounds between stored tables.
STORE_EVERY = 5


def scaled_plan(costs: DataFrame, keys: list[str], reg: float = 0.1, rounds: int = 20) -> DataFrame:
    """(keys, i, j, cost, mass): the transport plan after ``rounds`` of scaling rows and then columns.

    ``a`` and ``b`` are the masses of i and j; rows without mass on either side carry none."""
    if reg <= 0 or rounds < 1:
        raise ValueError("reg must be above 0 and rounds at least 1")
    live = costs.where("a > 0 and b > 0")
    # a key's least cost is taken off, which changes no plan and keeps the kernel from vanishing
    least = live.groupBy(*keys).agg(F.min("cost").alias("_least"))
    kernel = stored(live.join(least, keys).select(*keys, "i", "j", "cost", "a", "b", F.exp(-(F.col("cost") - F.col("_least")) / reg).alias("k")), "transport-kernel")
    v = kernel.select(*keys, "j").distinct().withColumn("v", F.lit(1.0))
    for n in range(rounds):
        u = kernel.join(v, [*keys, "j"]).groupBy(*keys, "i").agg((F.max("a") / F.sum(F.col("k") * F.col("v"))).alias("u"))
        v = kernel.join(u, [*keys, "i"]).groupBy(*keys, "j").agg((F.max("b") / F.sum(F.col("k") * F.col("u"))).alias("v"))
        if (n + 1) % STORE_EVERY == 0 and n + 1 < rounds:
            v = stored(v, "transport-scaling")
    u, v = stored(u, "transport-rows"), stored(v, "transport-columns")
    return kernel.join(u, [*keys, "i"]).join(v, [*keys, "j"]).select(*keys, "i", "j", "cost", (F.col("u") * F.col("k") * F.col("v")).alias("mass"))


def transport_costs(costs: DataFrame, keys: list[str], reg: float = 0.1, rounds: int = 20) -> DataFrame:
    """(keys, cost): the plan's cost by key."""
    return scaled_plan(costs, keys, reg, rounds).groupBy(*keys).agg(F.sum(F.col("mass") * F.col("cost")).alias("cost"))
