"""Regression methods over clients and steps from sufficient statistics: each (client, step) is d x d numbers.

``prequential_regression``: batches are tested on their first half with the model in force, the
second half is fitted by least squares, and models are averaged at each federation step over all
clients, over those of a concept, or not at all. ``mixture_of_regressions``: clients are assigned
to the line that fits them best and lines refitted, in turn, by DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.operators.products import second_moments
from driftlake.sources.generators import half_split, ordinary_least_squares
from driftlake.sources.shared import stored

#: Lines of a mixture at most; their coefficients are broadcast.
MOST_LINES = 256


def prequential_regression(samples: DataFrame, every: int, share: str | None = "all", ridge: float = 1e-6) -> DataFrame:
    """(client, t, mse, r2) of samples (client, t, row_id, x, y[, concept]).

    ``share``: models averaged over "all" clients, over clients of the same "concept", or None,
    where each client keeps its own last fit. Averages are made after each ``every``-th step but
    the last and hold from the next one on; before the first, the model is 0. r2 is 1 less the
    error by the variance of the test half, 0 at least."""
    if every < 1 or share not in ("all", "concept", None):
        raise ValueError("every must be at least 1 and share all, concept or None")
    split = half_split(samples)
    fits = ordinary_least_squares(split.where("split = 'train'"), ["client", "t"], ridge)
    cells = samples.groupBy("client", "t").agg(F.first("concept").alias("concept")) if share == "concept" else samples.select("client", "t").distinct()
    last = samples.agg(F.max("t").alias("last"))
    steps = fits.join(cells, ["client", "t"]).join(F.broadcast(last)).where(((F.col("t") + 1) % every == 0) & (F.col("t") < F.col("last")) if share else F.lit(True))
    keys = {"all": [], "concept": ["concept"], None: ["client"]}[share]
    long = steps.select(*keys, "t", F.posexplode("coef").alias("i", "v")).groupBy(*keys, "t", "i").agg(F.avg("v").alias("v"))
    models = long.groupBy(*keys, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("coef"))
    # each model holds until the next one of its kind: an equi-join on the step it was made at
    asked = cells.select("client", "t", *[k for k in keys if k != "client"]).withColumn("_at", F.col("t"))
    made = models.select(*keys, F.col("t").alias("_at"), "coef")
    both = asked.select(*keys, F.col("t").alias("_at")).distinct().join(made, [*keys, "_at"], "full")
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("coef", F.last("coef", ignorenulls=True).over(before))
    model = asked.join(held, [*keys, "_at"], "left").select("client", "t", "coef")
    tests = split.where("split = 'test'").select("client", "t", "x", F.col("y").cast("double").alias("y")).join(model, ["client", "t"], "left")
    guess = F.when(F.col("coef").isNull(), 0.0).otherwise(V.dot(F.concat("x", F.array(F.lit(1.0))), "coef"))
    by = tests.withColumn("e", F.col("y") - guess).groupBy("client", "t").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.var_pop("y").alias("v"))
    return by.select("client", "t", "mse", F.greatest(F.lit(0.0), 1 - F.col("mse") / F.greatest("v", F.lit(1e-12))).alias("r2"))


def _residual(moments: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Sums of squared residuals (clients x lines) from moments of (x, 1, y)."""
    v = np.concatenate([-lines, np.ones((len(lines), 1))], 1)
    return np.einsum("li,cij,lj->cl", v, moments, v)


def mixture_of_regressions(samples: DataFrame, client: str, lines: int, rounds: int = 20, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(assignment (client, line, loss), lines (line, coef)) of samples (client, x, y).

    Starts from the client of smallest id and then, in turn, the one that is fitted worst so far;
    assignment and fit alternate until no client moves, ``rounds`` times at most. A task adds up
    its clients' moments by line, so a round's shuffle is a few rows a task. Losses are means;
    ties go to the smaller line. Fewer clients than lines give fewer lines."""
    if not 1 <= lines <= MOST_LINES:
        raise ValueError(f"lines must lie between 1 and {MOST_LINES}")
    kind = samples.schema[client].dataType.simpleString()
    both = samples.select(client, F.concat("x", F.array(F.lit(1.0), F.col("y").cast("double"))).alias("z"))
    held = stored(second_moments(both, [client], "z"), "client-moments")
    first = held.select(F.size("mean")).first()
    fields = f"`{client}` {kind}, line int, loss double"
    if first is None:
        return samples.sparkSession.createDataFrame([], fields), samples.sparkSession.createDataFrame([], "line int, coef array<double>")
    d = first[0]

    def whole(part: pd.DataFrame) -> np.ndarray:
        mean, n = np.stack(part["mean"]), part["n"].to_numpy(float)
        return np.stack(part["m2"]).reshape(-1, d, d) + n[:, None, None] * mean[:, :, None] * mean[:, None, :]

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:-1, :-1] + ridge * np.eye(d - 1), m[:-1, -1])

    def assigned(now: np.ndarray) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    loss = _residual(whole(part), now)
                    at = loss.argmin(1)
                    yield pd.DataFrame({client: part[client], "line": at.astype(np.int32), "loss": loss[np.arange(len(at)), at] / part["n"].to_numpy()})

        return held.mapInPandas(run, fields)

    def fitted(now: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(now), d, d))
            for part in parts:
                if len(part):
                    m = whole(part)
                    np.add.at(total, _residual(m, now).argmin(1), m)
            used = np.flatnonzero(total[:, -2, -2])
            yield pd.DataFrame({"line": used.astype(np.int32), "m": [total[i].ravel() for i in used]})

        # a few rows a task, at most one for each line
        sums = held.mapInPandas(run, "line int, m array<double>").select("line", F.posexplode("m").alias("i", "v")).groupBy("line", "i").agg(F.sum("v").alias("v"))
        new, got = now.copy(), sums.toPandas()
        for line, part in got.groupby("line"):
            m = np.zeros(d * d)
            m[part["i"].to_numpy()] = part["v"].to_numpy()
            new[line] = solve(m.reshape(d, d))
        return new

    start = held.orderBy(client).limit(1).toPandas()
    now = solve(whole(start)[0])[None]
    while len(now) < lines:
        worst = assigned(now).orderBy(F.desc("loss"), client).limit(1).first()
        if worst is None or worst["loss"] <= 1e-12:
            break
        now = np.concatenate([now, solve(whole(held.where(F.col(client) == worst[client]).toPandas())[0])[None]])
    for _ in range(rounds):
        new = fitted(now)
        if np.allclose(new, now, rtol=1e-10, atol=1e-12):
            break
        now = new
    table = samples.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(now)], "line int, coef array<double>")
    return assigned(now), table
