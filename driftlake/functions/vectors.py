"""Column functions over array<double>: similarities, entropies and normalisations.

All stay in the JVM as higher-order functions; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def square_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, guard: float = 1e-12) -> Column:
    """In [-1, 1]; 0 where a norm is (nearly) 0."""
    size = norm(a) * norm(b)
    return F.when(size > guard, dot(a, b) / size).otherwise(0.0)


def cosine01(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def gaussian_similarity(a: Column | str, b: Column | str, variance: Column | str, groups: list[tuple[int, int, float]] | None = None) -> Column:
    """exp(-1/2 sum (a - b)^2 / variance), with one variance for each component, 1e-8 at least.

    With groups (start, end, weight) of components, the weighted mean of the groups' similarities."""
    gap = F.zip_with(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), col(variance), lambda d, v: d / F.greatest(v, F.lit(1e-8)))
    if not groups:
        return F.exp(-0.5 * total(gap))
    if any(start < 0 or end <= start or weight < 0 for start, end, weight in groups) or sum(g[2] for g in groups) <= 0:
        raise ValueError("groups must be spans with weights of at least 0, one above 0")
    mass = sum(g[2] for g in groups)
    return sum((F.lit(weight / mass) * F.exp(-0.5 * total(F.slice(gap, start + 1, end - start))) for start, end, weight in groups if weight > 0), F.lit(0.0))


def normalise(a: Column | str) -> Column:
    """Divided by its sum; uniform where the sum is 0."""
    s = total(a)
    return F.transform(col(a), lambda x: F.when(s > 0, x / s).otherwise(F.lit(1.0) / F.size(col(a))))


def hellinger_similarity(p: Column | str, q: Column | str) -> Column:
    gap = total(F.zip_with(col(p), col(q), lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), 2.0)))
    return 1 - F.sqrt(0.5 * gap)


def scaled_similarity(a: Column | str, b: Column | str) -> Column:
    """exp(-1/2 mean (a-b)^2 / (mean |a| + mean |b|)) over the shorter length."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = F.slice(col(a), 1, n), F.slice(col(b), 1, n)
    scale = (total(F.transform(x, F.abs)) + total(F.transform(y, F.abs))) / n
    return F.when(scale > 1e-12, F.exp(-0.5 * square_distance(x, y) / n / scale)).otherwise(F.when(square_distance(x, y) > 0, 0.0).otherwise(1.0))


def mean_scaled_similarity(a: Column | str, b: Column | str) -> Column:
    """exp(-1/2 mean squared gap / scale), the scale being the sum of both mean absolute values, 1e-8 at least; over the shorter's length, 1 for empty vectors."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = F.slice(col(a), 1, n), F.slice(col(b), 1, n)
    scale = F.greatest((total(F.transform(x, F.abs)) + total(F.transform(y, F.abs))) / n, F.lit(1e-8))
    return F.when(n == 0, 1.0).otherwise(F.exp(-0.5 * square_distance(x, y) / n / scale))


def classifier_rows(coef: Column | str, intercept: Column | str, features: int, classes: int) -> Column:
    """A linear classifier's parameters as rows by class: coefficients, then the bias.

    A binary classifier with one row stands for both classes, with opposite signs. Other sizes are an error."""
    coef, intercept = col(coef), col(intercept)
    row = lambda c: F.concat(F.slice(coef, c * features + 1, features), F.array(F.element_at(intercept, c + 1)))
    whole = F.array(*[row(c) for c in range(classes)])
    fits = (F.size(coef) == classes * features) & (F.size(intercept) == classes)
    wrong = F.raise_error(F.lit(f"parameters don't fit {features} features and {classes} classes")).cast("array<array<double>>")
    if classes != 2:
        return F.when(fits, whole).otherwise(wrong)
    one = F.concat(coef, intercept)
    single = (F.size(coef) == features) & (F.size(intercept) == 1)
    return F.when(single, F.array(F.transform(one, lambda v: -v), one)).when(fits, whole).otherwise(wrong)


def classifier_params(rows: Column | str, features: int, classes: int) -> Column:
    """(coef, intercept) of rows by class; of a binary classifier the second row alone."""
    rows = col(rows)
    kept = F.slice(rows, 2, 1) if classes == 2 else rows
    bad = (F.size(rows) != classes) | F.exists(rows, lambda r: F.size(r) != features + 1)
    wrong = F.raise_error(F.lit(f"rows don't fit {features} features and {classes} classes")).cast("array<double>")
    coef = F.when(bad, wrong).otherwise(F.flatten(F.transform(kept, lambda r: F.slice(r, 1, features))))
    return F.named_struct(F.lit("coef"), coef, F.lit("intercept"), F.transform(kept, lambda r: F.element_at(r, features + 1)))


def prototype_similarity(a: Column | str, b: Column | str) -> Column:
    return 0.5 * cosine01(a, b) + 0.5 * F.exp(-square_distance(a, b) / F.size(col(a)))


def l2_normalise(a: Column | str) -> Column:
    size = norm(a)
    return F.transform(col(a), lambda x: F.when(size > 1e-12, x / size).otherwise(x))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, not once an element of a lambda in it."""
    return F.transform(F.array(value), body)[0]


def softmax(a: Column | str) -> Column:
    e = _bound(F.array_max(col(a)), lambda top: F.transform(col(a), lambda x: F.exp(x - top)))
    return _bound(e, lambda v: _bound(total(v), lambda z: F.transform(v, lambda x: x / z)))


def log_sum_exp(a: Column | str) -> Column:
    return _bound(F.array_max(col(a)), lambda top: top + F.log(total(F.transform(col(a), lambda x: F.exp(x - top)))))


def entropy(p: Column | str, floor: float = 1e-12) -> Column:
    return total(F.transform(col(p), lambda x: -F.greatest(x, F.lit(floor)) * F.log(F.greatest(x, F.lit(floor)))))


def blend(a: Column | str, b: Column | str, share: float) -> Column:
    """(1 - share) a + share b."""
    return F.zip_with(col(a), col(b), lambda x, y: (1 - share) * x + share * y)


def wasserstein_equal(a: Column | str, b: Column | str) -> Column:
    """1-D transport distance of two samples of the same size."""
    return total(F.zip_with(F.array_sort(col(a)), F.array_sort(col(b)), lambda x, y: F.abs(x - y))) / F.size(col(a))


def top_weights(weights: Column | str, k: int, least: float = 0.01) -> Column:
    """The k largest entries of a map<id, weight> over ``least``, renormalised; ties to the smaller id."""
    kept = F.map_filter(col(weights), lambda _, w: w > least)
    rows = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("id"))))
    best = F.slice(rows, 1, k)
    mass = F.aggregate(best, F.lit(0.0), lambda s, e: s - e["minus"])
    return F.map_from_entries(F.transform(best, lambda e: F.struct(e["id"], -e["minus"] / mass)))


def sharpen(weights: Column | str, tau: float) -> Column:
    """w^(1/tau), renormalised."""
    powered = F.transform_values(col(weights), lambda _, w: F.pow(w, 1 / tau))
    mass = total(F.map_values(powered))
    return F.transform_values(powered, lambda _, w: w / mass)


def checked_mass(a: Column | str) -> Column:
    """Normalised mass; an error where a component is negative or not finite, or all are 0."""
    bad = F.exists(col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)) | ~(total(a) > 0)
    return F.when(bad, F.raise_error(F.lit("mass must be finite, not negative and above 0 in sum")).cast("array<double>")).otherwise(normalise(a))
