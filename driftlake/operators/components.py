"""Principal components of vectors: one Gram matrix, a small eigenproblem, projection inside the plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.operators.products import second_moments


def principal_components(rows: DataFrame, most: int, keys: list[str] | None = None, vector: str = "x") -> DataFrame:
    """(keys, n, mean, variances, loadings): the ``most`` directions of largest variance, first largest.

    Each loading has length 1 and its component of largest size above 0. A key's vectors are only
    ever seen as their second moments; with fewer than two of them nothing varies."""
    keys = keys or []
    moments = second_moments(rows if keys else rows.withColumn("_all", F.lit(0)), keys or ["_all"], vector)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for n, mean, m2 in zip(part["n"], part["mean"], part["m2"], strict=True):
                d = len(mean)
                values, vectors = np.linalg.eigh(np.asarray(m2).reshape(d, d) / max(n - 1, 1))
                order = np.argsort(-values, kind="stable")[: min(most, d)]
                own = vectors[:, order].T
                own = own * np.sign(own[np.arange(len(own)), np.abs(own).argmax(1)])[:, None]
                found.append((np.maximum(values[order], 0.0), list(own)))
            yield part[[*keys, "n", "mean"]].assign(variances=[v for v, _ in found], loadings=[w for _, w in found])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return moments.mapInPandas(run, f"{kinds}n long, mean array<double>, variances array<double>, loadings array<array<double>>")


def projected(vector: Column | str, mean: Column | str, loadings: Column | str) -> Column:
    """The components of a vector: its inner products with the loadings, less the mean's."""
    gap = F.zip_with(V.col(vector), V.col(mean), lambda x, m: x - m)
    return F.transform(V.col(loadings), lambda w: V.dot(gap, w))


def project(rows: DataFrame, components: DataFrame, keys: list[str] | None = None, vector: str = "x") -> DataFrame:
    """``rows`` with their components as ``components``.

    Without keys the components are one row, which is broadcast; its size is that of ``most`` vectors."""
    own = components.select(*(keys or []), F.col("mean").alias("_mean"), F.col("loadings").alias("_loadings"))
    both = rows.join(own, keys) if keys else rows.crossJoin(F.broadcast(own))
    return both.withColumn("components", projected(vector, "_mean", "_loadings")).drop("_mean", "_loadings")
