"""Shrinkage of concept models to the overall model, as aggregations over (client, concept, idx, val, weight).

A concept's model is the weighted mean of its clients'. The noise of clients within concepts
(``sigma2``), the spread of concepts less what that noise explains (``between2``) and the number
of dimensions in which concepts differ (``d_eff``) give each concept its coefficient. Parameters
are reduced to one row for (concept, idx) and then one for idx; models are never gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sigma2 where no concept has two clients.
NO_NOISE = 1e-4
#: Concepts whose products are one square matrix at most.
MOST_CONCEPTS = 4096


def concept_models(params: DataFrame) -> DataFrame:
    """(concept, idx, val, clients, own2): weighted means; ``own2`` sums squared distances of clients to it."""
    mean = F.sum(F.col("weight") * F.col("val")) / F.sum("weight")
    by = params.groupBy("concept", "idx").agg(mean.alias("val"), F.count("*").alias("clients"), F.avg("val").alias("plain"), F.var_pop("val").alias("spread"))
    gap = F.col("plain") - F.col("val")
    return by.select("concept", "idx", "val", "clients", (F.col("clients") * (F.col("spread") + gap * gap)).alias("own2"))


def variances(models: DataFrame) -> DataFrame:
    """One row (concepts, clients_mean, sigma2, between2) of rows of ``concept_models``.

    sigma2 is the mean squared distance over concepts of two clients or more; between2 the
    variance of concepts around their plain mean, by dimension, less sigma2 / clients_mean."""
    several = F.col("clients") >= 2
    by = models.groupBy("idx").agg(
        F.count("*").alias("c"), (F.var_pop("val") * F.count("*")).alias("apart"), F.sum(F.when(several, F.col("own2"))).alias("own2"), F.sum(F.when(several, F.col("clients"))).alias("terms"), F.avg("clients").alias("clients")
    )
    one = by.agg(F.max("c").alias("concepts"), F.avg("clients").alias("clients_mean"), F.try_divide(F.sum("own2"), F.sum("terms")).alias("sigma2"), F.try_divide(F.sum("apart"), (F.max("c") - 1) * F.count("*")).alias("apart"))
    sigma2 = F.coalesce("sigma2", F.lit(NO_NOISE))
    between2 = F.when(F.col("concepts") < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("apart") - sigma2 / F.col("clients_mean")))
    return one.select("concepts", "clients_mean", sigma2.alias("sigma2"), between2.alias("between2"))


def concept_products(models: DataFrame) -> DataFrame:
    """(a, b, dot) for a <= b: products of the concepts' models around their mean."""
    centre = models.groupBy("idx").agg(F.avg("val").alias("centre"))
    rows = models.join(centre, "idx").select("concept", "idx", (F.col("val") - F.col("centre")).alias("v"))
    left, right = rows.select(F.col("concept").alias("a"), "idx", F.col("v").alias("x")), rows.select(F.col("concept").alias("b"), "idx", F.col("v").alias("y"))
    return left.join(right, "idx").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def effective_dimensions(models: DataFrame) -> DataFrame:
    """One row (d_eff): squared sum of the singular values of the concepts' models around their mean, by the sum of their squares; 1 at least.

    The singular values are roots of the eigenvalues of a matrix with one row a concept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        names = pd.Index(rows["a"]).union(rows["b"]).unique()
        if len(names) > MOST_CONCEPTS:
            raise ValueError(f"{len(names)} concepts, more than {MOST_CONCEPTS}")
        at, dot = (names.get_indexer(rows["a"]), names.get_indexer(rows["b"])), np.zeros((len(names), len(names)))
        dot[at], dot[at[::-1]] = rows["dot"], rows["dot"]
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(dot), 0.0)) if len(names) else np.zeros(0)
        s = s[s > 1e-7 * s.max(initial=0.0)]
        yield pd.DataFrame({"d_eff": [max(1.0, s.sum() ** 2 / (s * s).sum()) if len(s) else 1.0]})

    return concept_products(models).coalesce(1).mapInPandas(run, "d_eff double")


def coefficients(models: DataFrame, d_eff: DataFrame | float, least_concepts: int = 2, least_snr: float | None = None) -> DataFrame:
    """(concept, clients, sigma2, between2, d_eff, lam): sampling variance by all variance, 1/2 where there is none of either.

    Nothing is drawn (0) with fewer concepts than ``least_concepts`` or where between2 is under ``least_snr`` times the mean sampling variance."""
    one = variances(models)
    one = one.withColumn("d_eff", F.lit(float(d_eff))) if not isinstance(d_eff, DataFrame) else one.crossJoin(d_eff)  # one row each
    v = F.col("sigma2") * F.col("d_eff") / F.col("clients")
    mean_v = F.col("sigma2") * F.col("d_eff") / F.greatest(F.col("clients_mean"), F.lit(1.0))
    lam: Column = F.when(v + F.col("between2") > 1e-30, v / (v + F.col("between2"))).otherwise(0.5)
    if least_snr is not None:
        lam = F.when(F.when(mean_v > 1e-30, F.col("between2") / mean_v).otherwise(0.0) < least_snr, 0.0).otherwise(lam)
    lam = F.when(F.col("concepts") < least_concepts, 0.0).otherwise(lam)
    own = models.groupBy("concept").agg(F.max("clients").alias("clients"))
    return own.crossJoin(F.broadcast(one)).select("concept", "clients", "sigma2", "between2", "d_eff", lam.alias("lam"))


def fitted(params: DataFrame, sigma2: float, n: int, r_eff: float | None = None) -> DataFrame:
    """One row (clients, concepts, dimensions, between2, lam_iso, lam_aniso): the estimator with known noise.

    Each of the clients has ``n`` samples, so a concept's model rests on n times the mean number of
    its clients; ``lam_iso`` takes all dimensions for the effective ones, ``lam_aniso`` ``r_eff`` of them."""
    models = concept_models(params)
    one = variances(models).crossJoin(params.agg(F.countDistinct("client").alias("clients"), F.countDistinct("idx").alias("dimensions")))
    own = F.col("clients_mean") * n  # samples of a concept
    by = models.groupBy("idx").agg((F.var_pop("val") * F.count("*")).alias("apart"), F.count("*").alias("c")).agg(F.try_divide(F.sum("apart"), (F.max("c") - 1) * F.count("*")).alias("apart"))
    between2 = F.when(F.col("concepts") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("apart") - sigma2 / own))
    lam = lambda d: F.when(sigma2 * d / own + F.col("between2") > 0, F.least(F.lit(1.0), sigma2 * d / own / (sigma2 * d / own + F.col("between2")))).otherwise(0.5)
    rows = one.drop("between2").crossJoin(by).withColumn("between2", between2)
    aniso = F.col("dimensions") if r_eff is None else F.lit(float(r_eff))
    return rows.select("clients", "concepts", "dimensions", "between2", lam(F.col("dimensions")).alias("lam_iso"), lam(aniso).alias("lam_aniso"))


def shrunken_models(params: DataFrame, models: DataFrame, lam: DataFrame) -> DataFrame:
    """(concept, idx, val): own model and, with share lam, the weighted mean of all clients."""
    overall = params.groupBy("idx").agg((F.sum(F.col("weight") * F.col("val")) / F.sum("weight")).alias("overall"))
    both = models.join(overall, "idx").join(lam.select("concept", "lam"), "concept")
    return both.select("concept", "idx", ((1 - F.col("lam")) * F.col("val") + F.col("lam") * F.col("overall")).alias("val"))
