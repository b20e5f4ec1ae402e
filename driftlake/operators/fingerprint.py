"""Mergeable fingerprints of (client, t) batches.

A fingerprint is sufficient statistics: counts, sums and sums of products. They
are built in long form by plain aggregations (partial sums on the map side), so a
batch is never gathered in a task; dense vectors are assembled at the end."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import vectors as V
from driftlake.operators.products import second_moments


def features(samples: DataFrame) -> DataFrame:
    """Samples (client, t, row_id, x, y) in long form."""
    return samples.select("client", "t", "row_id", "y", F.posexplode("x").alias("idx", "v"))


def moments(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, var): vectors of means and sample variances; variance 1 for a single row."""
    long = samples.select(*keys, F.posexplode("x").alias("idx", "v"))
    by = long.groupBy(*keys, "idx").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda s: s[c])
    by = by.withColumn("var", F.when(F.col("n") < 2, 1.0).otherwise(F.col("var")))
    return by.groupBy(*keys).agg(F.max("n").alias("n"), at("mean").alias("mean"), at("var").alias("var"))


def label_distribution(samples: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, labels): shares of labels 0..classes-1; other labels are left out, uniform if none is left."""
    counts = [F.count(F.when(F.col("y") == c, 1)).cast("double") for c in range(classes)]
    return samples.groupBy(*keys).agg(F.array(*counts).alias("counts")).select(*keys, V.normalise("counts").alias("labels"))


def prototypes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, n, mean): class means."""
    return moments(samples, [*keys, "y"]).select(*keys, "y", "n", "mean")


def build(samples: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, n, mean, var, labels, class_n, class_mean): the whole fingerprint, one row each.

    Class entries are maps, so classes that are absent take no room."""
    proto = prototypes(samples, keys).where((F.col("y") >= 0) & (F.col("y") < classes))
    maps = proto.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("class_n"), F.map_from_entries(F.collect_list(F.struct("y", "mean"))).alias("class_mean"))
    return moments(samples, keys).join(label_distribution(samples, keys, classes), keys).join(maps, keys, "left")


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merges fingerprints (keys, n, mean, var) by the parallel formula, as sums in long form.

    Squares are taken around a first mean of each group, so large means don't cancel."""
    long = parts.select(*keys, "n", F.posexplode(F.arrays_zip("mean", "var")).alias("idx", "z")).select(*keys, "n", "idx", F.col("z.mean").alias("m"), F.col("z.var").alias("v"))
    near = long.groupBy(*keys, "idx").agg(F.min("m").alias("near"))
    long = long.join(near, [*keys, "idx"]).withColumn("m", F.col("m") - F.col("near"))
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    square = F.sum(F.when(F.col("n") > 1, F.col("v") * (F.col("n") - 1)).otherwise(0.0) + F.col("n") * F.col("m") * F.col("m"))
    by = long.groupBy(*keys, "idx").agg(n.alias("n"), (F.min("near") + s / n).alias("mean"), F.when(n > 1, (square - s * s / n) / (n - 1)).otherwise(1.0).alias("var"))
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c])
    return by.groupBy(*keys).agg(F.max("n").alias("n"), at("mean").alias("mean"), at("var").alias("var"))


def covariance(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, cov) for i <= j; the identity for a single row."""
    m = second_moments(samples, keys)
    d = F.size("mean")
    long = m.select(*keys, "n", d.alias("d"), F.posexplode("m2").alias("at", "s"))
    long = long.select(*keys, "n", F.floor(F.col("at") / F.col("d")).cast("int").alias("i"), (F.col("at") % F.col("d")).alias("j"), "s").where("i <= j")
    return long.select(*keys, "i", "j", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).otherwise((F.col("i") == F.col("j")).cast("double")).alias("cov"))


def effective_rank(samples: DataFrame, keys: list[str]) -> DataFrame:
    """trace^2 / squared Frobenius norm of the covariance: no decomposition is needed."""
    m = second_moments(samples, keys)
    trace, square = _trace("m2"), V.total(F.transform("m2", lambda v: v * v))
    return m.select(*keys, F.when(square > 0, trace * trace / square).otherwise(0.0).alias("effective_rank"))


def _trace(flat: Column | str) -> Column:
    """The trace of a flat d x d matrix beside the mean of length d."""
    return V.total(F.transform("mean", lambda _, i: F.get(V.col(flat), i * F.size("mean") + i)))


def dense_prototypes(samples: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, y, n, mean) for every class: 0 rows and a mean of zeros where a class is absent."""
    proto = prototypes(samples, keys).where((F.col("y") >= 0) & (F.col("y") < classes))
    whole = moments(samples, keys).select(*keys, F.transform("mean", lambda _: F.lit(0.0)).alias("zeros"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))).alias("y"))
    both = whole.join(proto, [*keys, "y"], "left")
    return both.select(*keys, "y", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mean", "zeros").alias("mean"))


#: Names of the features that fingerprints can be made of.
SOURCES = (
    "raw_input", "model_embed", "pre_adapter_embed", "hybrid_raw_pre_adapter", "weighted_hybrid_raw_pre_adapter", "centered_hybrid_raw_pre_adapter",
    "attenuated_hybrid_raw_pre_adapter", "double_raw_hybrid_pre_adapter", "bootstrap_raw_hybrid_pre_adapter",
)


def source_features(samples: DataFrame, source: str, keys: list[str], bootstrap: int | None = None) -> DataFrame:
    """Samples (keys, x, pre, post) with ``x`` made of the raw features and a model's, by the name of the source.

    ``bootstrap``: zeros of that length stand for a model that isn't there yet."""
    if source not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    if source.startswith("centered"):
        # the batch mean is one row a batch
        mean = moments(samples.withColumn("x", F.col("pre")), keys).select(*keys, F.col("mean").alias("_mean"))
        return samples.join(mean, keys).withColumn("x", F.concat("x", F.zip_with("pre", "_mean", lambda v, m: v - m))).drop("_mean")
    if source.startswith("bootstrap"):
        return samples.withColumn("x", F.concat("x", F.col("pre") if bootstrap is None else F.array_repeat(F.lit(0.0), bootstrap)))
    made = {"raw_input": F.col("x"), "model_embed": F.col("post"), "pre_adapter_embed": F.col("pre"), "attenuated_hybrid_raw_pre_adapter": F.concat("x", F.transform("pre", lambda v: v * 0.25)), "double_raw_hybrid_pre_adapter": F.concat("x", "x", "pre")}
    return samples.withColumn("x", made.get(source, F.concat("x", "pre")))


def similarity(pairs: DataFrame, least: int = 3, groups: list[tuple[int, int, float]] | None = None, weights: tuple[float, float, float] = (0.25, 0.30, 0.45)) -> DataFrame:
    """Adds ``similarity`` to pairs of fingerprints with columns a_* and b_*.

    .25 of the features' Gaussian similarity under the mean variance, .30 of the labels'
    Hellinger similarity, .45 of the class means', over classes that both hold ``least`` times
    (other weights can be given, and groups of features); 0 where a fingerprint has fewer than two rows."""
    variance = F.zip_with("a_var", "b_var", lambda x, y: (x + y) / 2)
    feature = V.gaussian_similarity("a_mean", "b_mean", variance, groups)
    label = V.hellinger_similarity("a_labels", "b_labels")
    both = F.filter(F.map_keys("a_class_n"), lambda k: (F.element_at("a_class_n", k) >= least) & (F.coalesce(F.try_element_at("b_class_n", k), F.lit(0)) >= least))
    each = F.transform(both, lambda k: V.gaussian_similarity(F.element_at("a_class_mean", k), F.element_at("b_class_mean", k), variance, groups))
    conditional = F.when(F.size(both) > 0, V.total(each) / F.size(both)).otherwise(0.0)
    s = weights[0] * feature + weights[1] * label + weights[2] * conditional
    return pairs.withColumn("similarity", F.when((F.col("a_n") < 2) | (F.col("b_n") < 2), 0.0).otherwise(s))


def key_vector(prints: DataFrame, classes: int) -> DataFrame:
    """Fingerprints with ``key``: mean, label shares and all class means (zeros where a class is absent) in one vector."""
    zeros = F.transform("mean", lambda _: F.lit(0.0))
    means = F.flatten(F.array(*[F.coalesce(F.try_element_at("class_mean", F.lit(c).cast("long")), zeros) for c in range(classes)]))
    return prints.withColumn("key", F.concat("mean", "labels", means))


def faded_sums(rows: DataFrame, keys: list[str], nth: str, value: Column, decay: float, name: str) -> DataFrame:
    """Adds ``name``: each row's value and, times ``decay``, that of the row before; ``nth`` numbers a key's rows from 1.

    A running sum of value / decay^k, times decay^k, in blocks in which the powers stay in range; of
    the blocks before, one row each is kept and fades on as a whole."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    size = max(1, min(1024, int(-200 / math.log10(decay))))
    power = lambda c: F.pow(F.lit(decay), c)
    rows = rows.withColumn("_block", F.floor((F.col(nth) - 1) / size)).withColumn("_k", (F.col(nth) - 1) % size)
    inside = Window.partitionBy(*keys, "_block").orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(value / power(F.col("_k"))).over(inside) * power(F.col("_k")))
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_own", nth).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.aggregate(F.collect_list("_end").over(earlier), F.lit(0.0), lambda a, v: a * decay**size + v)
    rows = rows.join(ends.select(*keys, "_block", carried.alias("_before")), [*keys, "_block"])
    return rows.withColumn(name, F.col("_own") + F.col("_before") * power(F.col("_k") + 1)).drop("_block", "_k", "_own", "_before")


def retrieval_keys(prints: DataFrame, classes: int, decay: float = 0.0, order: str = "t", by: str = "client") -> DataFrame:
    """(by, order, style, semantic, prototype): a client's keys, each faded into the one before by ``decay``.

    The faded mean of a history is a weighted sum over it: decay^0 (1 - decay) of the latest, and so
    on, with decay^(n - 1) of the first; it is made in blocks of a client's history."""
    zeros = F.transform("mean", lambda _: F.lit(0.0))
    means = F.flatten(F.array(*[F.coalesce(F.try_element_at("class_mean", F.lit(c).cast("long")), zeros) for c in range(classes)]))
    rows = prints.select(by, order, F.concat("mean", "labels", means).alias("v"), F.size("mean").alias("d"))
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("nth", F.row_number().over(w)).select(by, order, "d", "nth", F.posexplode("v").alias("i", "x"))
    if decay:
        step = F.when(F.col("nth") == 1, F.col("x")).otherwise((1 - decay) * F.col("x"))
        rows = faded_sums(rows, [by, "i"], "nth", step, decay, "_faded").withColumn("x", F.col("_faded")).drop("_faded")
    back = rows.groupBy(by, order, "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    part = lambda lo, n: F.slice("v", lo, n)
    d, k = F.col("d"), F.lit(classes)
    return back.select(by, order, part(F.lit(1), d).alias("style"), part(d + 1, k).alias("semantic"), part(d + k + 1, d * k).alias("prototype"))


def retrieval_similarity(style: tuple, semantic: tuple, prototype: tuple, weights: tuple[float, float, float] = (0.25, 0.30, 0.45)) -> Column:
    """Of two keys' parts: scaled similarities of style and prototypes and the Hellinger similarity of label shares, weighted."""
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be at least 0, one above 0")
    s, l, p = (x / sum(weights) for x in weights)
    return s * V.mean_scaled_similarity(*style) + l * V.hellinger_similarity(*semantic) + p * V.mean_scaled_similarity(*prototype)


def subgroup_stats(prints: DataFrame, group: str) -> DataFrame:
    """(group, y, mass, mean): class means of a group's fingerprints, weighted by their label mass (share times rows).

    A class without mass in the whole group is left out."""
    each = prints.select(group, F.greatest(F.col("n").cast("double"), F.lit(1.0)).alias("n"), F.posexplode("labels").alias("y", "share"), "class_mean").where("share > 0")
    each = each.select(group, F.col("y").cast("long").alias("y"), (F.col("share") * F.col("n")).alias("mass"), F.try_element_at("class_mean", F.col("y").cast("long")).alias("mean"))
    long = each.select(group, "y", "mass", F.posexplode("mean").alias("idx", "v"))
    by = long.groupBy(group, "y", "idx").agg(F.sum("mass").alias("mass"), (F.sum(F.col("mass") * F.col("v")) / F.sum("mass")).alias("v")).where("mass > 1e-8")
    return by.groupBy(group, "y").agg(F.max("mass").alias("mass"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda s: s["v"]).alias("mean"))


def participation_ratio(samples: DataFrame, keys: list[str], center: bool = True) -> DataFrame:
    """(keys, ratio): squared trace over squared Frobenius norm of the features' second moments, about the mean or about 0.

    Null where all are 0."""
    m = second_moments(samples, keys)
    flat = F.col("m2") if center else F.transform("m2", lambda v, at: v + F.col("n") * F.get("mean", F.floor(at / F.size("mean")).cast("int")) * F.get("mean", at % F.size("mean")))
    m = m.withColumn("flat", flat)
    trace, square = _trace("flat"), V.total(F.transform("flat", lambda v: v * v))
    return m.select(*keys, F.when(square > 0, trace * trace / square).alias("ratio"))


def all_pairs(prints: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs a < b of fingerprints of the same group ``within`` (a step, say), with a_* and b_* columns."""
    side = lambda p: prints.select(*[F.col(c).alias(c if c == within else f"{p}_{c}") for c in prints.columns])
    return side("a").join(side("b"), within).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def consecutive_stability(prints: DataFrame) -> DataFrame:
    """Mean cosine of a client's means at consecutive steps; steps without norm are left out."""
    w = Window.partitionBy("client").orderBy("t")
    rows = prints.select("client", "mean", F.lag("mean").over(w).alias("was")).where("was is not null")
    rows = rows.where((V.norm("mean") > 1e-12) & (V.norm("was") > 1e-12))
    return rows.groupBy("client").agg(F.avg(V.cosine("mean", "was")).alias("stability"))
