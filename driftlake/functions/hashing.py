"""Uniform and Poisson numbers from hashes of keys: the same on every engine and in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Poisson(1): the chance of k or less, for k from 0 on; beyond the last one lies 1e-9.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974149, 0.9999998885745217, 0.9999999899522336]


def hash_unit(*keys: Column | str) -> Column:
    """In [0, 1), from the first 48 bits of the MD5 of the keys joined by |."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def unit_sql(text: str) -> str:
    """The same in DuckDB, of an expression that gives the joined keys."""
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


def poisson(unit: Column) -> Column:
    """How often a row stands in a Poisson bootstrap's replicate."""
    return sum(((unit >= p).cast("long") for p in POISSON), F.lit(0).cast("long"))


def poisson_sql(unit: str) -> str:
    return "(" + " + ".join(f"CAST({unit} >= {p!r} AS BIGINT)" for p in POISSON) + ")"
