"""Scalar column functions: configuration, names, parsing, formats and parameter names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concept_count(rho: Column, steps: Column) -> Column:
    """Concepts of a schedule: all steps if the stay is infinite, else at least two; half goes to even."""
    return F.when(rho == math.inf, steps.cast("long")).otherwise(F.greatest(F.lit(2).cast("long"), F.bround(steps / F.when(rho != math.inf, rho)).cast("long")))


def run_name(generator: Column, rho: Column, alpha: Column, delta: Column, seed: Column) -> Column:
    whole = F.when(rho == math.inf, F.lit("inf")).otherwise(F.bround(F.when(rho != math.inf, rho)).cast("long").cast("string"))
    two = lambda c: F.format_string("%.2f", c)
    return F.concat(generator, F.lit("_rho"), whole, F.lit("_alpha"), two(alpha), F.lit("_delta"), two(delta), F.lit("_seed"), seed.cast("string"))


def parse_floats(text: Column) -> Column:
    """A comma list of numbers; 'inf' is infinity."""
    one = lambda x: F.when(F.lower(F.trim(x)).isin("inf", "infinity"), F.lit(math.inf)).otherwise(F.trim(x).try_cast("double"))
    return F.transform(F.split(text, ","), one)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_status(text: Column) -> Column:
    """Small letters, with an underscore for each space and hyphen; empty for null."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\s+|\s+$", "")
    return F.translate(F.lower(bare), "- ", "__")


def has_evidence(texts: list[Column], lists: list[Column] = ()) -> Column:
    """Whether some text is not blank, or some list has an item that is not."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    found = [~blank(t) for t in texts] + [F.coalesce(F.exists(x, lambda v: ~blank(v.cast("string"))), F.lit(False)) for x in lists]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def crossover_snr(clients: Column, n: Column, concepts: Column, delta: Column, sigma: Column, d: Column) -> Column:
    """Signal-to-noise ratio at which sharing and separate models break even; NaN without noise or features."""
    between = (concepts - 1) / (concepts * concepts) * delta * delta
    return F.when((sigma == 0) | (d == 0), F.lit(math.nan)).otherwise(clients * F.floor(n / 2) * between / (sigma * sigma * d))


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, as C's printf gives it: its exact binary value rounded, halves to the even digit.

    Java's formatter rounds the shortest decimal form and takes halves up: 106.5 has no decimals as 107."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(f"%.{digits}f".__mod__)

    return F.when(value.isNotNull(), run(value.cast("double")))


def shown(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit("--")).otherwise(fixed(value, digits))


def shown_pm(mean: Column, std: Column, digits: int = 3) -> Column:
    return F.when(mean.isNull() | F.isnan(mean), F.lit("--")).otherwise(F.concat(shown(mean, digits), F.lit("±"), shown(F.coalesce(std, F.lit(0.0)), digits)))


def shown_bytes(n: Column, units: dict[str, float] | None = None) -> Column:
    """A size in the largest of the units (M and K by default) that it reaches."""
    out = fixed(n, 0)
    for unit, least in sorted((units or {"M": 1e6, "K": 1e3}).items(), key=lambda u: u[1]):
        out = F.when(n >= least, F.concat(fixed(n / least, 1), F.lit(unit))).otherwise(out)
    return out


def or_nan(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(math.nan))


def namespace(key: Column) -> Column:
    """shared, expert or other."""
    return F.when(key.startswith("shared."), "shared").when(key.rlike(r"^expert\.[0-9]+\."), "expert").otherwise("other")


def expert_slot(key: Column) -> Column:
    return F.regexp_extract(key, r"^expert\.([0-9]+)\.", 1).try_cast("int")


def remap_expert(key: Column, slot: Column) -> Column:
    return F.when(namespace(key) == "expert", F.concat(F.lit("expert."), slot.cast("string"), F.regexp_replace(key, r"^expert\.[0-9]+", ""))).otherwise(key)


def canonical_method(name: Column, aliases: dict[str, str], prefixes: tuple[str, ...] = ()) -> Column:
    out = name
    for p in prefixes:
        out = F.when(name.startswith(p + "-"), F.lit(p)).otherwise(out)
    for a, b in aliases.items():
        out = F.when(name == a, F.lit(b)).otherwise(out)
    return out


def identity_valid(name: Column, capable: list[str], aliases: dict[str, str], prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a method, by its canonical name, infers concept identities, so that metrics of identity mean something."""
    return F.coalesce(canonical_method(name, aliases, prefixes).isin(capable), F.lit(False))


def deduped_methods(methods: DataFrame, name: str, order: str, aliases: dict[str, str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Of methods with one canonical name the first, but never an alias where the canonical name itself is asked for."""
    named = methods.withColumn("_canonical", canonical_method(F.col(name), aliases, prefixes)).withColumn("_alias", (F.col("_canonical") != F.col(name)) & F.col(name).isin(list(aliases)))
    w = Window.partitionBy("_canonical")
    rows = named.withColumn("_asked", F.max((~F.col("_alias")).cast("int")).over(w)).where(~F.col("_alias") | (F.col("_asked") == 0))
    return rows.withColumn("_nth", F.row_number().over(w.orderBy(order))).where("_nth = 1").drop("_nth", "_asked", "_alias", "_canonical")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Ordered dedupe: of each key the row that comes first."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def year_bin(year: Column, first: int, last: int, bins: int) -> Column:
    """Equal-width bins of years from ``first`` to ``last``, numbered from 0 and clipped."""
    at = F.width_bucket(year.cast("double"), F.lit(float(first)), F.lit(float(last + 1)), F.lit(bins).cast("long")) - 1
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(bins - 1).cast("long"), at))


def shrinkage_lambda(sigma2: Column, between2: Column, clients: Column, concepts: Column, n: Column, d_eff: Column) -> Column:
    """v / (v + between), v the sampling variance of a concept's mean; 1/2 where both are 0."""
    v = sigma2 * d_eff / (n * clients / concepts)
    both = v + between2
    return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / both))).otherwise(0.5)
