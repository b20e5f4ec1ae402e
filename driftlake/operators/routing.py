"""Routing of clients to concept slots: signatures, mixed losses, splits, buffers and caches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.operators import solvers


def projection(d: int, out: int, seed: int) -> list[list[float]]:
    """A seeded Gaussian matrix (out rows) over sqrt(d)."""
    return (np.random.default_rng(seed).normal(size=(out, d)) / np.sqrt(d)).tolist()


def signature(vector: Column | str, matrix: list[list[float]]) -> Column:
    """The vector times a small fixed matrix, of norm 1: literals inside the plan, no UDF."""
    rows = F.array(*[V.dot(vector, F.array(*[F.lit(float(x)) for x in r])) for r in matrix])
    return V.l2_normalise(rows)


def row_signatures(rows: Column | str, matrix: list[list[float]]) -> Column:
    """Signatures of an array of vectors (a classifier's rows), one each."""
    return F.transform(V.col(rows), lambda r: signature(r, matrix))


def delta_signatures(now: Column | str, before: Column | str, matrix: list[list[float]]) -> Column:
    """Signatures of what has changed between two classifiers' rows."""
    gaps = F.zip_with(V.col(now), V.col(before), lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
    return row_signatures(gaps, matrix)


def prototype_signatures(means: Column | str, counts: Column | str, matrix: list[list[float]]) -> Column:
    """Signatures of class means, each with its share of all rows as a last component; classes without rows have mean 0."""
    all_ = F.greatest(F.lit(1.0), V.total(F.transform(V.col(counts), lambda n: n.cast("double"))))
    rows = F.zip_with(V.col(means), V.col(counts), lambda m, n: F.concat(m, F.array(n.cast("double") / all_)))
    return row_signatures(rows, matrix)


def hybrid_loss(fingerprint_loss: Column, parts: dict[str, tuple[Column, float]]) -> Column:
    """The fingerprint's loss and 1 - similarity of the parts that are known (not null), by weight.

    The fingerprint takes what weight the known parts leave of 1; where they leave none, its weight is 1."""
    known = {k: (s, float(w)) for k, (s, w) in parts.items() if w > 0}
    taken = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in known.values()), F.lit(0.0))
    lost = sum((F.coalesce((1 - s) * w, F.lit(0.0)) for s, w in known.values()), F.lit(0.0))
    own = F.when(taken < 1, 1 - taken).otherwise(1.0)
    return (lost + own * fingerprint_loss) / (taken + own)


def routing_loss(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of 1 - similarity over the parts that are known (not null); 1 where none is."""
    weight = sum((F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in parts.values()), F.lit(0.0))
    loss = sum((F.coalesce((1 - s) * w, F.lit(0.0)) for s, w in parts.values()), F.lit(0.0))
    return F.when(weight > 0, loss / weight).otherwise(1.0)


def transport_similarity(pairs: DataFrame, key: str, tau: float = 1.0, reg: float = 0.1) -> DataFrame:
    """(key, similarity) of pairs of weighted point sets a_points, a_mass, b_points, b_mass by entropic transport.

    Each pair is solved alone; a null or empty side gives similarity 0."""

    def run(batches):
        for part in batches:
            out = []
            for r in part.itertuples():
                ok = all(x is not None and len(x) for x in (r.a_points, r.a_mass, r.b_points, r.b_mass))
                if not ok or min(np.sum(r.a_mass), np.sum(r.b_mass)) <= 0:
                    out.append(0.0)
                    continue
                a, b = np.stack(r.a_points), np.stack(r.b_points)
                cost = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
                out.append(solvers.transport_similarity(cost, np.asarray(r.a_mass, float), np.asarray(r.b_mass, float), tau, reg=reg))
            yield pd.DataFrame({key: part[key], "similarity": out})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "a_points", "a_mass", "b_points", "b_mass").mapInPandas(run, f"{key} {kind}, similarity double")


def _grouped(rows: DataFrame, group: str, member: str, solve) -> DataFrame:
    kinds = rows.schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(member).reset_index(drop=True)
        labels = solve(np.stack(part["vector"]).astype(float))
        return pd.DataFrame({group: part[group], member: part[member], "cluster": np.asarray(labels, int)})

    return rows.select(group, member, "vector").groupBy(group).applyInPandas(run, f"{group} {kinds[group].dataType.simpleString()}, {member} {kinds[member].dataType.simpleString()}, cluster long")


def two_way_split(rows: DataFrame, group: str, member: str, least_gap: float = 0.0) -> DataFrame:
    """In each group the least similar pair seeds two halves; all join the more similar seed.

    Groups are the clients of a concept in a round, bounded by the federation's size."""

    def solve(x: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.zeros(len(x), int)
        sims = np.array([[solvers.cosine(a, b) for b in x] for a in x])
        i, j = divmod(int(np.where(np.eye(len(x), dtype=bool), np.inf, sims).argmin()), len(x))
        return np.zeros(len(x), int) if 1 - sims[i, j] <= least_gap else (sims[:, j] > sims[:, i]).astype(int)

    return _grouped(rows, group, member, solve)


def novel_clusters(rows: DataFrame, group: str, member: str, threshold: float) -> DataFrame:
    """Greedy clusters of a round's novel clients, in order of their ids."""
    return _grouped(rows, group, member, lambda x: solvers.greedy_clusters(x, threshold))


def spectral_clusters(rows: DataFrame, group: str, member: str) -> DataFrame:
    return _grouped(rows, group, member, solvers.spectral)


def largest_clusters(clusters: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` clusters a group: by size, then mean gap, then smallest member."""
    sizes = clusters.groupBy(group, "cluster").agg(F.count("*").alias("size"), F.avg("gap").alias("mean_gap"), F.min("member").alias("first"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), F.desc("mean_gap"), "first"))
    return sizes.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def composed_download(weights: DataFrame, params: DataFrame) -> DataFrame:
    """Each client's model from the slots it reads (client, slot, w): shared parameters are
    weighted means, experts are all taken, other parameters come from its heaviest slot."""
    rows = weights.where("w > 0").join(params, "slot")
    shared = rows.where("name like 'shared.%'").groupBy("client", "name", "idx").agg((F.sum(F.col("w") * F.col("val")) / F.sum("w")).alias("val"))
    first = F.min_by("val", F.struct((-F.col("w")).alias("minus"), "slot"))
    rest = rows.where("name not like 'shared.%'").groupBy("client", "name", "idx").agg(first.alias("val"))
    return shared.unionByName(rest)


def anchor_buffer(rows: DataFrame, length: int, decay: float) -> DataFrame:
    """(slot, seq, anchor): mean of a slot's last ``length`` values, each step older weighing ``decay`` times as much."""
    w = Window.partitionBy("slot").orderBy("seq").rowsBetween(-(length - 1), 0)
    held = F.collect_list("value").over(w)
    weight = lambda i, n: F.pow(F.lit(decay), n - 1 - i)
    n = F.size("held")
    total = F.aggregate(F.transform("held", lambda v, i: v * weight(i, n)), F.lit(0.0), lambda s, x: s + x)
    mass = F.aggregate(F.transform("held", lambda v, i: weight(i, n)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("held", held).select("slot", "seq", (total / mass).alias("anchor"))


def cached_value(rows: DataFrame, expires: int) -> DataFrame:
    """(key, round, value): the latest value that is not null and at most ``expires`` rounds old."""
    w = Window.partitionBy("key").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("value").isNotNull(), F.col("round")), ignorenulls=True).over(w)
    value = F.last("value", ignorenulls=True).over(w)
    return rows.select("key", "round", F.when(F.col("round") - at <= expires, value).alias("value"))


def frozen_rounds(drift: DataFrame, threshold: float) -> DataFrame:
    """(round, frozen): addressing rests in rounds whose mean drift is at most the threshold; never in the first."""
    by = drift.groupBy("round").agg(F.avg("drift").alias("mean_drift"))
    return by.select("round", "mean_drift", ((F.col("round") > 0) & (F.col("mean_drift") <= threshold)).alias("frozen"))


def recall_model(versions: DataFrame, asks: DataFrame) -> DataFrame:
    """For each ask (slot, round) the slot's latest version stored at or before that round: an as-of join
    as one sorted pass, by a union and a window."""
    both = versions.select("slot", "round", "val", F.lit(0).alias("ask")).unionByName(asks.select("slot", "round", F.lit(None).cast("double").alias("val"), F.lit(1).alias("ask")))
    w = Window.partitionBy("slot").orderBy("round", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("val", F.last("val", ignorenulls=True).over(w)).where("ask = 1").select("slot", "round", "val")


def dimensions(samples: DataFrame) -> DataFrame:
    """Clients, steps, features and classes of a sample table, in one pass."""
    return samples.agg(F.countDistinct("client").alias("clients"), (F.max("t") + 1).alias("steps"), F.max(F.size("x")).alias("features"), (F.max("y") + 1).alias("classes"))


def ensure_round_trip(grid: DataFrame, every: int) -> DataFrame:
    """Steps at which clients federate: every ``every`` steps, but not the last."""
    last = grid.agg(F.max("t").alias("last"))
    return grid.select("t").distinct().crossJoin(F.broadcast(last)).where(((F.col("t") + 1) % every == 0) & (F.col("t") < F.col("last"))).select("t")
