"""Nested results as rows: values of JSON documents by path, rolled up along the tree of paths, and root causes of a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nesting at most; deeper documents are an error.
MOST_LEVELS = 64


def flatten(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, text): the scalars of each document, with paths like $.a.b[0]; JSON null is a null text.

    Objects and arrays are exploded level by level as variants, so all documents of a table may
    have their own shape. Documents that are null or no JSON, and empty containers, give no row."""
    at = rows.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    tvf, found = rows.sparkSession.tvf, []
    for _ in range(MOST_LEVELS):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        found.append(at.where(~nested).select(*keys, "path", F.try_variant_get("v", "$", "string").alias("text")))
        below = at.where(nested)
        if below.isEmpty():
            return reduce(DataFrame.unionByName, found)
        each = below.lateralJoin(tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        at = each.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"documents are nested deeper than {MOST_LEVELS} levels")


def roll_up(values: DataFrame, groups: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """(groups, node, depth, n, mean, low, high): numbers under each node of the tree of paths, the root $ included.

    Places in arrays are one node, written []. Texts that are no number count in ``n`` only."""
    star = F.regexp_replace(F.col(path), r"\[[0-9]+\]", "[]")
    steps = F.regexp_extract_all(star, F.lit(r"(\$|\.[^.\[]+|\[\])"), 1)
    number = F.col(text).try_cast("double")
    each = values.select(*groups, number.alias("_x"), steps.alias("_steps")).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("_steps"))))
    by = each.groupBy(*groups, F.array_join(F.slice("_steps", 1, F.col("depth")), "").alias("node"), F.col("depth").cast("long").alias("depth"))
    return by.agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.min("_x").alias("low"), F.max("_x").alias("high"))


def root_causes(runs: DataFrame, outcome: str, signals: dict[str, int], sides: tuple[str, str] = ("baseline", "candidate"), least: float = 1e-6) -> DataFrame:
    """(signal, baseline, candidate, change, seeds_worse, seeds, verdict, nth) of runs (side, seed, signals…, outcome).

    A signal's direction is 1 if more of it is better, else -1. Means are of each side's known
    values; a signal is to blame (``worse``) if it moved the wrong way while the outcome fell too,
    ``better`` if it moved the right way, ``same`` within ``least``, ``unknown`` if a side lacks it.
    Signals are ordered by blame, then by size of the relative change. ``seeds_worse`` counts seeds
    of both sides whose mean outcome fell."""
    side = lambda s, c: F.avg(F.when(F.col("side") == s, F.col(c)))
    by_seed = runs.groupBy("seed").agg(side(sides[0], outcome).alias("a"), side(sides[1], outcome).alias("b")).where("a is not null and b is not null")
    seeds = by_seed.agg(F.count("*").alias("seeds"), F.count(F.when(F.col("b") < F.col("a") - least, 1)).alias("seeds_worse"))
    names = [*signals, outcome]
    one = runs.agg(*[side(s, c).alias(f"{k}_{i}") for i, c in enumerate(names) for k, s in zip("ab", sides, strict=True)])
    fell = F.coalesce(F.col(f"b_{len(signals)}") < F.col(f"a_{len(signals)}") - least, F.lit(False))
    entry = [F.struct(F.lit(c).alias("signal"), F.lit(d).alias("direction"), F.col(f"a_{i}").alias("baseline"), F.col(f"b_{i}").alias("candidate")) for i, (c, d) in enumerate(signals.items())]
    long = one.select(fell.alias("fell"), F.explode(F.array(*entry)).alias("s")).select("fell", "s.*")
    change = F.col("candidate") - F.col("baseline")
    moved = change * F.col("direction")
    verdict = F.when(change.isNull(), "unknown").when(F.abs(change) <= least, "same").when(moved > 0, "better").when(F.col("fell"), "worse").otherwise("tolerated")
    size = F.abs(change) / F.greatest(F.abs("baseline"), F.lit(1e-12))
    order: list[Column] = [F.when(verdict == "worse", 0).otherwise(1), F.desc_nulls_last(size), F.col("signal")]
    from pyspark.sql import Window

    ranked = long.select("signal", "baseline", "candidate", change.alias("change"), verdict.alias("verdict"), F.row_number().over(Window.orderBy(*order)).alias("nth"))  # one row a signal
    return ranked.crossJoin(seeds).select("signal", "baseline", "candidate", "change", "seeds_worse", "seeds", "verdict", "nth")
