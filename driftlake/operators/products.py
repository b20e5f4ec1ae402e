"""Second moments of vectors by key, in one pass and without exploding their products.

Each task sums its rows' outer products around their own means as matrix products and hands on
one row for each key; those are merged by the parallel formula. Rows are never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task holds matrices for before it hands them on.
HELD = 256


def _merged(a: tuple[int, np.ndarray, np.ndarray] | None, b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def second_moments(rows: DataFrame, keys: list[str], vector: str = "x") -> DataFrame:
    """(keys, n, mean, m2): number, mean and flat d x d matrix of centred sums of products of each key's vectors.

    Vectors of a key must be of one length, without nulls; rows whose vector is null are left out."""
    rows = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).alias("_v"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n long, mean array<double>, m2 array<double>"

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame([[*key, n, mean, m2.ravel()] for key, (n, mean, m2) in held.items()], columns=[*keys, "n", "mean", "m2"])

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for part in parts:
            for key, at in part.groupby(keys, dropna=False).indices.items():
                x = np.array([np.asarray(v, float) for v in part["_v"].iloc[at]])
                mean = x.mean(0)
                key = key if isinstance(key, tuple) else (key,)
                held[key] = _merged(held.get(key), (len(x), mean, (x - mean).T @ (x - mean)))
            if len(held) > HELD:
                yield frame(held)
                held = {}
        yield frame(held)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, m2 in zip(part["n"], part["mean"], part["m2"], strict=True):
            d = len(mean)
            total = _merged(total, (n, np.asarray(mean), np.asarray(m2).reshape(d, d)))
        return frame({tuple(part[k].iloc[0] for k in keys): total})

    return rows.mapInPandas(sums, schema).groupBy(*keys).applyInPandas(merge, schema)
