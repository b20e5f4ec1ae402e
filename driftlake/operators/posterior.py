"""Assignment of clients to concepts: posteriors over losses, nearest slots, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transition_log_prior(previous: Column, concept: Column, known: Column, stay: float) -> Column:
    """log of a sticky prior: uniform without a previous concept, certain with one known concept."""
    return (
        F.when(known <= 1, F.lit(0.0))
        .when(previous.isNull(), -F.log(known))
        .when(previous == concept, F.lit(math.log(stay)))
        .otherwise(F.log(F.lit(1 - stay) / (known - 1)))
    )


def gibbs(losses: DataFrame, keys: list[str], omega: float = 1.0, stay: float = 0.9, previous: str | None = None) -> DataFrame:
    """(keys, concept, loss[, previous]) with ``p``: softmax of -omega loss + log prior within each key."""
    if omega <= 0:
        raise ValueError("omega must be positive")
    w = Window.partitionBy(*keys)
    prior = transition_log_prior(F.col(previous) if previous else F.lit(None), F.col("concept"), F.count("*").over(w), stay)
    rows = losses.withColumn("log_p", -omega * F.col("loss") + prior)
    rows = rows.withColumn("e", F.exp(F.col("log_p") - F.max("log_p").over(w)))
    return rows.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e", "log_p")


def decide(posterior: DataFrame, keys: list[str], novelty: float = 0.5) -> DataFrame:
    """By key: the most probable concept (the smallest id among equals), its p, novelty and entropy."""
    p = F.greatest("p", F.lit(1e-15))
    best = F.min(F.struct((-F.col("p")).alias("minus"), "concept"))
    by = posterior.groupBy(*keys).agg(best.alias("best"), F.sum(-F.col("p") * F.log(p)).alias("entropy"))
    return by.select(*keys, F.col("best.concept").alias("concept"), (-F.col("best.minus")).alias("p"), (-F.col("best.minus") < novelty).alias("is_novel"), "entropy")


def top_candidates(posterior: DataFrame, keys: list[str], k: int, current: str | None = None) -> DataFrame:
    """The k most probable concepts of each key and, if named, its current one, whatever its rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), "concept")
    also = F.lit(False) if current is None else F.coalesce(F.col("concept") == F.col(current), F.lit(False))
    return posterior.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) | also)


def nearest_slot(items: DataFrame, slots: DataFrame, key: str, vector: str = "mean", slot_key: str = "slot", most_slots: int = 4096) -> DataFrame:
    """Each item's slot by smallest squared distance (the smallest id among equals).

    The library of slots is bounded by its capacity; that is checked before it is broadcast.
    Beyond the bound the slots are taken in parts and the best of the parts kept."""
    from driftlake.functions.vectors import square_distance

    n = slots.count()
    parts = max(1, -(-n // most_slots))
    best = None
    for i in range(parts):
        part = slots if parts == 1 else slots.where(F.pmod(F.hash(slot_key), F.lit(parts)) == i)
        pairs = items.select(key, vector).crossJoin(F.broadcast(part.select(slot_key, F.col(vector).alias("slot_vector"))))
        own = pairs.groupBy(key).agg(F.min(F.struct(square_distance(vector, "slot_vector").alias("loss"), slot_key)).alias("best"))
        best = own if best is None else best.unionByName(own).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col(f"best.{slot_key}").alias(slot_key), F.col("best.loss").alias("loss"))


def calibrate_omega(losses: DataFrame, keys: list[str], confidence: float = 0.9) -> DataFrame:
    """The sharpness at which a typical gap (median of the others less the best) gives ``confidence``; within 1 to 100.

    Gaps of 1e-8 or less are left out; the number of concepts is the whole part of its median over the others."""
    w = Window.partitionBy(*keys).orderBy("loss", "concept")
    ranked = losses.withColumn("rank", F.row_number().over(w))
    by = ranked.groupBy(*keys).agg(F.min("loss").alias("best"), F.median(F.when(F.col("rank") > 1, F.col("loss"))).alias("others"), F.count("*").alias("k")).where("k > 1")
    by = by.where("others - best > 1e-8")
    gap = F.avg(F.col("others") - F.col("best"))
    raw = F.log(F.lit(confidence / (1 - confidence)) * F.greatest(F.floor(F.median("k")) - 1, F.lit(1))) / gap
    return by.agg(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(100.0), raw)), F.lit(1.0)).alias("omega"), gap.alias("mean_gap"))


def round_diagnostics(losses: DataFrame, threshold: float) -> DataFrame:
    """By step: mean, least and greatest of the best losses, the mean gap to the second, and the share over a threshold."""
    w = Window.partitionBy("client", "t").orderBy("loss", "concept")
    ranked = losses.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    by = ranked.groupBy("client", "t").agg(F.min("loss").alias("best"), F.max(F.when(F.col("rank") == 2, F.col("loss"))).alias("second"))
    return by.groupBy("t").agg(
        F.avg("best").alias("mean_loss"), F.min("best").alias("least"), F.max("best").alias("most"),
        F.avg(F.col("second") - F.col("best")).alias("mean_gap"), F.avg((F.col("best") > threshold).cast("double")).alias("over"),
    )


def similarity_quantiles(pairs: DataFrame, quantiles: list[float]) -> DataFrame:
    return pairs.agg(*[F.percentile("similarity", q).alias(f"q{round(q * 100)}") for q in quantiles])


def medoids(pairs: DataFrame, group: str) -> DataFrame:
    """By group the member of greatest mean similarity to the others; pairs are (group, a, b, similarity), each once."""
    both = pairs.select(group, F.col("a").alias("member"), "similarity").unionByName(pairs.select(group, F.col("b").alias("member"), "similarity"))
    mean = both.groupBy(group, "member").agg(F.avg("similarity").alias("mean"))
    return mean.groupBy(group).agg(F.min(F.struct((-F.col("mean")).alias("minus"), "member")).alias("best")).select(group, F.col("best.member").alias("medoid"), (-F.col("best.minus")).alias("mean_similarity"))
