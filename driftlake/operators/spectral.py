"""Spectral clusters of groups of any size: a sparse neighbour graph and subspace iteration as joins.

1. Neighbours. In each of ``trees`` random directions the rows of a group are put in order and cut
   into blocks of ``block`` rows, which are compared as matrices; a row keeps its ``neighbours``
   nearest of all blocks. A group of one block has exact neighbours; a larger one costs
   trees x block comparisons a row.
2. Weights exp(-d^2 / 2h), h being the group's mean squared distance to neighbours; an edge of one
   direction counts in both.
3. ``rounds`` of V <- (V + N V) / 2, N being the normalised weights: an equi-join of edges and rows
   and an aggregation each. Columns are made orthonormal by their products, m x m sums a group.
4. Ritz values of N give the number of clusters by the eigengap, and the first Ritz vectors a row's
   place.
5. Rows that stand for the clusters are picked by pivoted QR: each task proposes as many as there are
   clusters for each of its groups, and those proposals are picked from again. A row goes to the
   picked direction that it agrees with most.

No task holds more than a block of a group's rows; what is gathered by group are m x m sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.functions.hashing import hash_unit
from driftlake.operators.solvers import eigengap
from driftlake.sources.pools import numbered
from driftlake.sources.shared import stored

STORE_EVERY = 5


def near_rows(rows: DataFrame, neighbours: int = 10, trees: int = 6, block: int = 512, seed: int = 42) -> DataFrame:
    """(g, a, b, d2): each row's nearest others of its group, for rows (g, id, x); ties go to smaller ids."""
    first = rows.select(F.size("x")).first()
    kind = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in (("g", "g"), ("a", "id"), ("b", "id")))
    if first is None:
        return rows.sparkSession.createDataFrame([], f"{kind}, d2 double")
    axes = np.random.default_rng(seed).normal(size=(trees, first[0])) / np.sqrt(first[0])
    along = F.array(*[V.dot("x", F.array(*[F.lit(float(v)) for v in axis])) for axis in axes])
    placed = rows.select("g", "id", "x", F.posexplode(along).alias("tree", "p"))
    scale = placed.groupBy("g", "tree").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"))
    placed = placed.join(scale, ["g", "tree"])
    unit = 1 / (1 + F.exp(-(F.col("p") - F.col("m")) / F.greatest("s", F.lit(1e-12)) * 1.7))
    placed = numbered(placed, ["g", "tree"], F.least(unit, F.lit(1 - 1e-9)), ["id"]).withColumn("block", F.floor(F.col("nth") / block))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, ids = np.stack(part["x"]).astype(float), part["id"].to_numpy()
        square = (x * x).sum(1)
        d2 = np.maximum(square[:, None] + square - 2 * x @ x.T, 0.0)
        np.fill_diagonal(d2, np.inf)
        k = min(neighbours, len(x) - 1)
        order = np.argsort(d2, 1, kind="stable")[:, :k]
        a = np.repeat(np.arange(len(x)), k)
        return pd.DataFrame({"g": part["g"].iloc[0], "a": ids[a], "b": ids[order.ravel()], "d2": d2[a, order.ravel()]})

    found = placed.select("g", "tree", "block", "id", "x").groupBy("g", "tree", "block").applyInPandas(run, f"{kind}, d2 double")
    found = found.groupBy("g", "a", "b").agg(F.min("d2").alias("d2"))
    nth = F.row_number().over(Window.partitionBy("g", "a").orderBy("d2", "b"))
    return found.withColumn("nth", nth).where(F.col("nth") <= neighbours).drop("nth")


def normalised_edges(near: DataFrame) -> DataFrame:
    """(g, a, b, w) in both directions: weights divided by the roots of both rows' sums."""
    width = near.groupBy("g").agg((F.avg("d2") + 1e-10).alias("h"))
    edges = near.unionByName(near.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "d2")).groupBy("g", "a", "b").agg(F.min("d2").alias("d2"))
    edges = edges.join(width, "g").select("g", "a", "b", F.exp(-F.col("d2") / (2 * F.col("h"))).alias("w"))
    degree = edges.groupBy("g", "a").agg(F.greatest(F.sum("w"), F.lit(1e-300)).alias("d"))
    both = edges.join(degree, ["g", "a"]).join(degree.select("g", F.col("a").alias("b"), F.col("d").alias("e")), ["g", "b"])
    return both.select("g", "a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def _products(left: list[str], right: list[str]) -> list:
    return [F.sum(F.col(p) * F.col(q)).alias(f"p{i}_{j}") for i, p in enumerate(left) for j, q in enumerate(right)]


def _solved(sums: DataFrame, m: int, solve, columns: str) -> DataFrame:
    """A small matrix for each group (one row each) from its m x m sums."""
    kind = sums.schema["g"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [solve(r) for r in part[[f"p{i}_{j}" for i in range(m) for j in range(m)]].to_numpy(float).reshape(-1, m, m)]
            yield pd.DataFrame([[g, *x] for g, x in zip(part["g"], got, strict=True)], columns=["g", *[c.split()[0] for c in columns.split(", ")]])

    return sums.mapInPandas(run, f"g {kind}, {columns}")


def _times(rows: DataFrame, small: DataFrame, m: int) -> DataFrame:
    """Rows (g, id, v0 …) times their group's matrix ``r``."""
    both = rows.join(small, "g")
    cell = lambda i, j: F.element_at(F.element_at("r", i + 1), j + 1)
    return both.select("g", "id", *[reduce(lambda x, y: x + y, [F.col(f"v{i}") * cell(i, j) for i in range(m)]).alias(f"v{j}") for j in range(m)])


def _orthonormal(gram: np.ndarray) -> list:
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return [(vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)).tolist()]


def ritz_rows(edges: DataFrame, most: int = 10, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, int]:
    """((g, id, k, v0 …), m): each row in its group's first Ritz vectors, and the number of clusters k."""
    m = most + 3
    names = [f"v{j}" for j in range(m)]
    edges = stored(edges, "graph-edges")
    ids = edges.select("g", F.col("a").alias("id")).distinct()
    rows = stored(ids.select("g", "id", *[(hash_unit(F.lit(seed), F.lit(j), "g", "id") - 0.5).alias(n) for j, n in enumerate(names)]), "graph-rows")

    def moved(rows: DataFrame, half: bool) -> DataFrame:
        other = rows.select("g", F.col("id").alias("b"), *names)
        sums = edges.join(other, ["g", "b"]).groupBy("g", F.col("a").alias("id")).agg(*[F.sum(F.col("w") * F.col(n)).alias(f"n{n}") for n in names])
        return rows.join(sums, ["g", "id"]).select("g", "id", *(names if not half else []), *[((F.col(n) + F.col(f"n{n}")) / 2).alias(n) if half else F.col(f"n{n}") for n in names])

    for i in range(rounds):
        rows = moved(rows, True)
        if (i + 1) % STORE_EVERY == 0 or i + 1 == rounds:
            rows = stored(rows, "graph-rows")
            rows = stored(_times(rows, _solved(rows.groupBy("g").agg(*_products(names, names)), m, _orthonormal, "r array<array<double>>"), m), "graph-rows")

    def ritz(h: np.ndarray) -> list:
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values, kind="stable")
        laplacian = 1 - values[order]
        return [vectors[:, order].tolist(), eigengap(laplacian, most)]

    after = moved(rows, False)
    small = _solved(after.groupBy("g").agg(*_products(names, [f"n{n}" for n in names])), m, ritz, "r array<array<double>>, k int")
    return stored(_times(rows, small.select("g", "r"), m).join(small.select("g", "k"), "g"), "ritz-rows"), m


def pivots(x: np.ndarray, k: int) -> np.ndarray:
    """The first k pivots of a pivoted QR of the rows of ``x``: each time the row of largest rest."""
    rest, out = x.astype(float).copy(), []
    for _ in range(min(k, len(x))):
        size = (rest * rest).sum(1)
        i = int(size.argmax())
        if size[i] < 1e-20:
            break
        out.append(i)
        u = rest[i] / np.sqrt(size[i])
        rest = rest - np.outer(rest @ u, u)
    return np.array(out, int)


def assigned_rows(ritz: DataFrame, m: int) -> DataFrame:
    """(g, id, cluster) from rows in Ritz vectors; clusters are numbered in the order their rows are picked."""
    names = [f"v{j}" for j in range(m)]
    kinds = ", ".join(f"{n} {ritz.schema[n].dataType.simpleString()}" for n in ("g", "k"))

    def propose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, own in part.groupby("g"):
                k = int(own["k"].iloc[0])
                x = own[names[:k]].to_numpy(float)
                at = pivots(x, k)
                yield pd.DataFrame({"g": own["g"].iloc[0], "k": k, "x": list(x[at])})

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["x"])
        x = x[np.lexsort(x.T[::-1])]
        at = pivots(x, int(part["k"].iloc[0]))
        u, _, w = np.linalg.svd(x[at].T, full_matrices=False)
        return pd.DataFrame({"g": [part["g"].iloc[0]], "turn": [(u @ w).tolist()]})

    proposed = ritz.mapInPandas(propose, f"{kinds}, x array<double>")
    turns = proposed.groupBy("g").applyInPandas(pick, f"g {ritz.schema['g'].dataType.simpleString()}, turn array<array<double>>")
    own = F.slice(F.array(*names), 1, F.size("turn"))
    scores = F.transform(F.sequence(F.lit(1), F.size(F.element_at("turn", 1))), lambda j: F.abs(V.total(F.zip_with(own, "turn", lambda x, row: x * F.element_at(row, j)))))
    return ritz.join(turns, "g").select("g", "id", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cluster"))


def spectral_groups(rows: DataFrame, most: int = 10, neighbours: int = 10, rounds: int = 20, trees: int = 6, block: int = 512, seed: int = 42) -> DataFrame:
    """(g, id, cluster) of rows (g, id, x); a row without another in its group is cluster 0."""
    ritz, m = ritz_rows(normalised_edges(near_rows(rows, neighbours, trees, block, seed)), most, rounds, seed)
    found = assigned_rows(ritz, m)
    return rows.select("g", "id").join(found, ["g", "id"], "left").select("g", "id", F.coalesce("cluster", F.lit(0)).alias("cluster"))
