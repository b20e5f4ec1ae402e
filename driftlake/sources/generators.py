"""Generators of drifting data: concept grids and samples, seeded by client and step.

Every row is made from its own key's seed, so a lost partition is made again alike
and no generator state passes between clients."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.operators.products import second_moments

KINDS = ("sine", "sea", "circle", "gaussian_linear", "gaussian_anisotropic", "regression")
# Thresholds of the SEA concepts, after Street and Kim (2001).
SEA_THRESHOLDS = (8.0, 9.0, 7.0, 9.5)


@dataclass(frozen=True)
class GeneratorConfig:
    clients: int = 5
    steps: int = 10
    n_samples: int = 100
    rho: float = 5.0
    alpha: float = 0.5
    delta: float = 0.5
    kind: str = "sine"
    seed: int = 42
    n_features: int = 10

    def __post_init__(self):
        if self.clients < 1 or self.steps < 1 or self.n_samples < 1:
            raise ValueError("clients, steps and n_samples must be at least 1")
        if not 0 <= self.alpha <= 1 or not 0 <= self.delta <= 1 or self.rho <= 0:
            raise ValueError("alpha and delta lie in [0, 1], rho above 0")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

    @property
    def concepts(self) -> int:
        return self.steps if math.isinf(self.rho) else max(2, round(self.steps / self.rho))

    @property
    def name(self) -> str:
        return f"{self.kind}_rho{self.rho:.0f}_alpha{self.alpha:.2f}_delta{self.delta:.2f}_seed{self.seed}"


def markov(steps: int, concepts: int, rng: np.random.Generator) -> np.ndarray:
    """A schedule that switches to another concept with chance (C-1)/(T-1); a permutation if C >= T."""
    if concepts >= steps:
        return rng.permutation(concepts)[:steps]
    switch = min(1.0, (concepts - 1) / max(1, steps - 1))
    out = np.empty(steps, np.int64)
    out[0] = rng.integers(concepts)
    for t in range(1, steps):
        move = rng.random() < switch
        out[t] = (out[t - 1] + rng.integers(1, concepts)) % concepts if move and concepts > 1 else out[t - 1]
    return out


def concept_grid(spark: SparkSession, c: GeneratorConfig) -> DataFrame:
    """(client, t, gt). With alpha 0 all clients share one schedule, with 1 each has its own,
    between them each cell takes the own one with chance alpha."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = markov(c.steps, c.concepts, np.random.default_rng([c.seed, 0]))
        for part in parts:
            for client in part["id"]:
                rng = np.random.default_rng([c.seed, 1, int(client)])
                own = markov(c.steps, c.concepts, rng)
                use = rng.random(c.steps) < c.alpha if 0 < c.alpha < 1 else np.full(c.steps, c.alpha == 1)
                yield pd.DataFrame({"client": client, "t": np.arange(c.steps), "gt": np.where(use, own, shared)})

    return spark.range(c.clients).mapInPandas(run, "client long, t long, gt long")


def balance_groups(grid: DataFrame, least: int) -> DataFrame:
    """By step, moves clients so that no concept in use has fewer than ``least``: small groups
    get clients of the largest group while it can spare them, else they join it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("client").reset_index(drop=True)
        for _ in range(len(part)):
            sizes = part["gt"].value_counts()
            small = sorted(sizes[sizes < least].items(), key=lambda x: (x[1], x[0]))
            if not small or len(sizes) < 2:
                break
            concept, size = small[0]
            most = min(sizes[sizes == sizes.max()].index)
            if most != concept and sizes[most] - (least - size) >= least:
                part.loc[part.index[part["gt"] == most][: least - size], "gt"] = concept
            else:
                other = min((k for k in sizes.index if k != concept), key=lambda k: (-sizes[k], k))
                part.loc[part["gt"] == concept, "gt"] = other
        return part

    return grid.select("client", "t", "gt").groupBy("t").applyInPandas(run, "client long, t long, gt long")


def concept_specs(spark: SparkSession, n: int, kind: str, delta: float) -> DataFrame:
    """(concept, kind, variant, noise): a dimension table."""
    variants = {"sine": 4, "sea": 4, "circle": n}.get(kind, n)
    return spark.range(n).select(F.col("id").alias("concept"), F.lit(kind).alias("kind"), (F.col("id") % variants).alias("variant"), F.lit(1 - delta).alias("noise"))


def draw(kind: str, concept: int, n: int, delta: float, seed: list[int], d: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """n labelled points of a concept. Noise goes onto the features after labelling."""
    rng = np.random.default_rng(seed)
    if kind == "sine":
        x = rng.random((n, 2))
        variant = concept % 4
        edge = np.sin(x[:, 0]) if variant < 2 else 0.5 + 0.3 * np.sin(3 * np.pi * x[:, 0])
        y = (x[:, 1] >= edge) ^ bool(variant % 2)
    elif kind == "sea":
        x = rng.random((n, 3)) * 10
        y = x[:, 0] + x[:, 1] > SEA_THRESHOLDS[concept % 4]
    elif kind == "circle":
        x = rng.random((n, 2))
        y = (x[:, 0] - (0.5 + 0.3 * concept) % 1) ** 2 + (x[:, 1] - 0.5) ** 2 <= 0.09
    else:
        axis = np.random.default_rng([42, 7919, concept]).normal(size=d)
        axis *= 3 * delta / np.linalg.norm(axis)
        x = rng.normal(size=(n, d))
        if kind == "gaussian_anisotropic":
            x[:, : min(5, d)] *= math.sqrt(10)
        z = x @ axis + rng.normal(size=n)
        return x, z if kind == "regression" else (z > 0).astype(np.int64)
    x = x + (1 - delta) * np.random.default_rng([*seed, 99999]).normal(size=x.shape)
    return x, y.astype(np.int64)


def samples(grid: DataFrame, c: GeneratorConfig) -> DataFrame:
    """(client, t, row_id, x, y) for each cell of a grid; y is a double for regression."""
    kind = "double" if c.kind == "regression" else "long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                x, y = draw(c.kind, int(r.gt), c.n_samples, c.delta, [c.seed, 2, int(r.client), int(r.t)], c.n_features)
                yield pd.DataFrame({"client": r.client, "t": r.t, "row_id": np.arange(len(y)), "x": list(x), "y": y})

    return grid.select("client", "t", "gt").mapInPandas(run, f"client long, t long, row_id long, x array<double>, y {kind}")


def phased_grid(spark: SparkSession, clients: int, steps: int, phases: list[list[int]], switch: float = 0.15, seed: int = 42) -> DataFrame:
    """Phases of equal length with a set of concepts each; within one, a client switches with a small chance."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.linspace(0, steps, len(phases) + 1).astype(int)
        for part in parts:
            for client in part["id"]:
                rng = np.random.default_rng([seed, 3, int(client)])
                out = np.empty(steps, np.int64)
                for p, among in enumerate(phases):
                    now = among[int(client) % len(among)]
                    for t in range(edges[p], edges[p + 1]):
                        if len(among) > 1 and rng.random() < switch:
                            now = rng.choice([a for a in among if a != now])
                        out[t] = now
                yield pd.DataFrame({"client": client, "t": np.arange(steps), "gt": out})

    return spark.range(clients).mapInPandas(run, "client long, t long, gt long")


# ---------------------------------------------------------------- sampling of tables


def _order(seed: int, *keys: str) -> Column:
    """A repeatable random order of rows, from their keys."""
    return F.xxhash64(*keys, F.lit(seed))


def per_class(pool: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each class, without replacement."""
    w = Window.partitionBy(label).orderBy(_order(seed, key), key)
    return pool.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def stratified_split(pool: DataFrame, strata: list[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: in each stratum max(1, round-half-even(n share)) rows are test."""
    w = Window.partitionBy(*strata)
    nth = F.row_number().over(w.orderBy(_order(seed, key), key))
    tests = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share).cast("long"))
    return pool.withColumn("split", F.when(nth <= tests, "test").otherwise("train"))


def half_split(samples_: DataFrame) -> DataFrame:
    """Prequential halves of each batch: the first is test, the second train."""
    w = Window.partitionBy("client", "t")
    return samples_.withColumn("split", F.when(F.row_number().over(w.orderBy("row_id")) <= F.floor(F.count("*").over(w) / 2), "test").otherwise("train"))


def balanced_draw(pool: DataFrame, label: str, key: str, n: int, classes: int, draws: DataFrame, seed: int = 42) -> DataFrame:
    """For each row of ``draws`` (client, t): n rows with replacement, n // C a class and the rest to the first classes."""
    w = Window.partitionBy(label)
    numbered = pool.withColumn("_nth", F.row_number().over(w.orderBy(key)) - 1)
    sizes = pool.groupBy(label).agg(F.count("*").alias("_size"))
    quota = F.lit(n // classes) + (F.col(label) < n % classes).cast("int")
    wanted = draws.join(sizes).withColumn("_i", F.explode(F.sequence(F.lit(1), quota))).where(quota > 0)
    wanted = wanted.withColumn("_nth", F.pmod(F.xxhash64("client", "t", label, "_i", F.lit(seed)), F.col("_size")))
    return wanted.drop("_size").join(numbered, [label, "_nth"]).drop("_nth", "_i")


def largest_remainder(shares: DataFrame, keys: list[str], share: str, total: int, label: str) -> DataFrame:
    """Whole numbers that sum to ``total`` by key: floors, and one more for the largest fractions."""
    exact = F.col(share) * total
    rows = shares.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    w = Window.partitionBy(*keys)
    left = F.lit(total) - F.sum("_floor").over(w)
    nth = F.row_number().over(w.orderBy(F.desc("_rest"), label))
    return rows.withColumn("n", F.col("_floor") + (nth <= left).cast("long")).drop("_floor", "_rest")


def dirichlet_shares(spark: SparkSession, clients: int, classes: int, alpha: float, seed: int = 42) -> DataFrame:
    """(client, label, share): each client's class shares."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for client in part["id"]:
                p = np.random.default_rng([seed, 4, int(client)]).dirichlet(np.full(classes, alpha))
                yield pd.DataFrame({"client": client, "label": np.arange(classes), "share": p})

    return spark.range(clients).mapInPandas(run, "client long, label long, share double")


def permute_labels(rows: DataFrame, label: str, concept: str, classes: int, full: bool = True, seed: int = 42) -> DataFrame:
    """Labels renamed by concept: a whole permutation or a swap of one pair; concept 0 keeps its labels."""

    def table(c: int) -> list[int]:
        rng = np.random.default_rng([seed, 5, c])
        out = np.arange(classes)
        if c and full:
            out = rng.permutation(classes)
        elif c:
            a, b = rng.choice(classes, 2, replace=False)
            out[[a, b]] = out[[b, a]]
        return out.tolist()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"_concept": part["_concept"], "_table": [table(int(c)) for c in part["_concept"]]})

    # one row a concept, however many there are
    tables = rows.where(F.col(concept).isNotNull()).select(F.col(concept).cast("long").alias("_concept")).distinct().mapInPandas(run, "_concept long, _table array<long>")
    both = rows.join(tables, F.col(concept).cast("long") == F.col("_concept"), "left")
    return both.select(*[F.get("_table", F.col(label).cast("int")).alias(label) if c == label else F.col(c) for c in rows.columns])


def class_subsets(concepts: int, classes: int, how: str = "disjoint", overlap: float = 0.5) -> list[list[int]]:
    """Classes of each concept: all, disjoint blocks (the last takes the rest) or overlapping runs around a circle."""
    if how == "none":
        return [list(range(classes))] * concepts
    size = max(1, classes // concepts)
    if how == "disjoint":
        return [list(range(c * size, (c + 1) * size if c < concepts - 1 else classes)) for c in range(concepts)]
    width = min(classes, max(size, math.ceil(size * (1 + overlap))))
    return [sorted((c * size + i) % classes for i in range(width)) for c in range(concepts)]


def participants(cells: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """By step, max(1, ceil(K share)) clients."""
    w = Window.partitionBy("t")
    nth = F.row_number().over(w.orderBy(_order(seed, "t", "client"), "client"))
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share))
    return cells.withColumn("_nth", nth).withColumn("_n", n).where("_nth <= _n").drop("_nth", "_n")


def ordinary_least_squares(samples_: DataFrame, keys: list[str], ridge: float = 1e-6) -> DataFrame:
    """(keys, coef): normal equations from second moments; only d^2 sums a group reach the solver."""
    both = samples_.select(*keys, F.concat("x", F.array(F.lit(1.0), F.col("y").cast("double"))).alias("x"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            coef = []
            for n, mean, m2 in zip(part["n"], part["mean"], part["m2"], strict=True):
                mean = np.asarray(mean)
                d = len(mean) - 1
                m = np.asarray(m2).reshape(d + 1, d + 1) + n * np.outer(mean, mean)
                coef.append(np.linalg.solve(m[:d, :d] + ridge * np.eye(d), m[:d, d]))
            yield part[keys].assign(coef=coef)

    kinds = ", ".join(f"{k} {samples_.schema[k].dataType.simpleString()}" for k in keys)
    return second_moments(both, keys).mapInPandas(solve, f"{kinds}, coef array<double>")
