"""Aggregation of model parameters in long form (client, key or concept, idx, val).

Every rule is a weighted group-by, so it has partial sums and never gathers a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.scalars import expert_slot, namespace


def weighted_mean(value: str = "val", weight: str | None = None) -> Column:
    if weight is None:
        return F.avg(value)
    return F.sum(F.col(weight) * F.col(value)) / F.sum(weight)


def fedavg(params: DataFrame, keys: list[str] = ["idx"], weight: str | None = "weight") -> DataFrame:  # noqa: B006
    """Weighted mean of each parameter; by concept, label or cluster if that is among the keys."""
    return params.groupBy(*keys).agg(weighted_mean("val", weight).alias("val"), F.count("*").alias("clients"))


def soft_aggregate(params: DataFrame, posterior: DataFrame, least: float = 0.01) -> DataFrame:
    """Concept models with weight times posterior; shares of ``least`` or less are left out."""
    w = params.select("client", "idx", "val", "weight").join(posterior.where(F.col("p") > least).select("client", "concept", "p"), "client")
    return w.groupBy("concept", "idx").agg((F.sum(F.col("weight") * F.col("p") * F.col("val")) / F.sum(F.col("weight") * F.col("p"))).alias("val"))


def aggregate_namespaced(params: DataFrame, posterior: DataFrame) -> DataFrame:
    """Parameters (client, name, idx, val, weight): shared ones over all clients, each expert's
    with the client's posterior of its slot; weights of 0 or less are left out."""
    rows = params.withColumn("space", namespace(F.col("name"))).withColumn("slot", expert_slot(F.col("name")))
    shared = rows.where("space <> 'expert'").select("name", "idx", "val", F.col("weight").alias("w"))
    expert = rows.where("space = 'expert'").join(posterior.select("client", F.col("concept").cast("int").alias("slot"), "p"), ["client", "slot"]).select("name", "idx", "val", (F.col("weight") * F.col("p")).alias("w"))
    return shared.unionByName(expert).where("w > 0").groupBy("name", "idx").agg(weighted_mean("val", "w").alias("val"))


def sparsify(params: DataFrame, share: float) -> DataFrame:
    """Of each client the parameters of greatest size, ties kept, with what is left as ``residual``."""
    n = F.count("*").over(Window.partitionBy("client"))
    rank = F.rank().over(Window.partitionBy("client").orderBy(F.desc(F.abs("val"))))
    keep = rank <= F.greatest(F.lit(1), F.ceil(n * share))
    return params.select("client", "idx", F.when(keep, F.col("val")).otherwise(0.0).alias("val"), F.when(keep, 0.0).otherwise(F.col("val")).alias("residual"), keep.alias("kept"))


def within_variance(params: DataFrame) -> DataFrame:
    """Mean squared distance of parameters to their concept's mean, over concepts of two clients at least."""
    by = params.groupBy("concept", "idx").agg(F.var_pop("val").alias("v"), F.count("*").alias("n")).where("n >= 2")
    return by.agg(F.coalesce(F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.lit(1e-4)).alias("sigma2"))


def shrink(params: DataFrame, lam: Column | float) -> DataFrame:
    """Concept means drawn to the mean of all concepts: (1 - lambda) own + lambda overall."""
    own = params.groupBy("concept", "idx").agg(F.avg("val").alias("own"))
    overall = F.avg("own").over(Window.partitionBy("idx"))
    return own.select("concept", "idx", ((1 - lam) * F.col("own") + lam * overall).alias("val"))


def shrinkage_grid(params: DataFrame, truth: DataFrame, steps: int = 51) -> DataFrame:
    """The lambda of an even grid with least squared error to ``truth`` (concept, idx, val); the first among equals.

    The error is a quadratic in lambda, so three sums give it for the whole grid."""
    own = params.groupBy("concept", "idx").agg(F.avg("val").alias("own"))
    rows = own.withColumn("all", F.avg("own").over(Window.partitionBy("idx"))).join(truth.withColumnRenamed("val", "true"), ["concept", "idx"])
    d, e = F.col("all") - F.col("own"), F.col("own") - F.col("true")
    sums = rows.agg(F.sum(d * d).alias("a"), F.sum(d * e).alias("b"), F.sum(e * e).alias("c"))
    grid = sums.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / (steps - 1))).alias("lam"))
    error = F.col("a") * F.col("lam") * F.col("lam") + 2 * F.col("b") * F.col("lam") + F.col("c")
    return grid.select(F.round(error, 9).alias("error"), "lam").agg(F.min(F.struct("error", "lam")).alias("best")).select(F.col("best.lam").alias("lam"), F.col("best.error").alias("error"))


def prototype_server(protos: DataFrame) -> DataFrame:
    """Global class means from clients' (y, n, mean), weighted by counts."""
    long = protos.select("y", "n", F.posexplode("mean").alias("idx", "v"))
    return long.groupBy("y", "idx").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("val"))


def align_to_prototypes(rows: DataFrame, protos: DataFrame, mix: float) -> DataFrame:
    """Classifier rows (y, idx, val) moved to the classes' prototypes; rows without one stay."""
    both = rows.join(protos.select("y", "idx", F.col("val").alias("proto")), ["y", "idx"], "left")
    return both.select("y", "idx", F.when(F.col("proto").isNull(), F.col("val")).otherwise((1 - mix) * F.col("val") + mix * F.col("proto")).alias("val"))


def blend_models(a: DataFrame, b: DataFrame, share: float, keys: list[str]) -> DataFrame:
    both = a.join(b.withColumnRenamed("val", "other"), keys, "left")
    return both.select(*keys, F.coalesce((1 - share) * F.col("val") + share * F.col("other"), F.col("val")).alias("val"))


def average_but(params: DataFrame, private: str) -> DataFrame:
    """Means of all named parameters but those whose name matches, which stay the client's own (normalisation or head layers)."""
    is_private = F.col("name").rlike(private)
    mean = params.where(~is_private).groupBy("name", "idx").agg(F.avg("val").alias("mean"))
    both = params.join(mean, ["name", "idx"], "left")
    return both.select("client", "name", "idx", F.coalesce("mean", "val").alias("val"))


def all_switches(grid: DataFrame) -> DataFrame:
    """(client, t, new, old) wherever a client's concept differs from that of its step before."""
    before = F.lag("concept").over(Window.partitionBy("client").orderBy("t"))
    return grid.select("client", "t", F.col("concept").alias("new"), before.alias("old")).where("new <> old")


def switched_clients(now: DataFrame, before: DataFrame) -> DataFrame:
    both = now.select("client", F.col("concept").alias("new")).join(before.select("client", F.col("concept").alias("old")), "client")
    return both.where("new <> old")
