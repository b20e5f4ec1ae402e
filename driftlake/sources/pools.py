"""Recurring concepts over a pool of features: each cell of a concept grid draws rows of its concept's classes.

The pool (row_id, label[, weight]) is any table, e.g. stored features of images. The rows of a
class are put in a random order by exponential keys, -ln(u) / weight, so that taking the first n
is weighted sampling without replacement; u is a hash, so a draw can be repeated anywhere. The
cells that want rows of a class take consecutive runs of that order. When it is used up, a new
epoch with new keys begins, so the work grows with the rows drawn; a run lies within one epoch,
so no cell draws a row twice. Cells and rows never meet but by an equi-join on their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.hashing import hash_unit
from driftlake.sources.shared import stored

#: Ranges in which a class's rows are numbered, so that no task numbers a class alone.
RANGES = 64


def numbered(rows: DataFrame, keys: list[str], unit: Column, ties: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``nth`` from 0: the place of a row within its keys by ``unit`` (in [0, 1)), then ``ties``.

    Places are counted within ranges of ``unit``; one row a range is counted on."""
    rows = rows.withColumn("_unit", unit).withColumn("_range", F.floor(F.col("_unit") * ranges))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_unit", *ties)) - 1
    return rows.withColumn("nth", inside).join(F.broadcast(sizes) if ranges <= RANGES and not keys else sizes, [*keys, "_range"]).withColumn("nth", F.col("nth") + F.col("_before")).drop("_unit", "_range", "_before")


def class_counts(concepts: DataFrame, n: int) -> DataFrame:
    """(concept, label, n) of rows (concept, label): n in equal parts, one more for the first classes."""
    by = Window.partitionBy("concept")
    nth, size = F.row_number().over(by.orderBy("label")) - 1, F.count("*").over(by)
    return concepts.select("concept", "label", (F.floor(F.lit(n) / size) + (nth < F.lit(n) % size).cast("long")).alias("n"))


def pool_recurrence(pool: DataFrame, grid: DataFrame, counts: DataFrame, seed: int = 42, weight: str | None = None) -> DataFrame:
    """(client, t, concept, label, row_id) for a grid (client, t, concept) and counts (label, n and any of client, t, concept).

    Counts of concepts make balanced draws; counts of clients or cells, as ``generators.largest_remainder``
    makes them of Dirichlet shares, make draws from these shares. Rows with n = 0 draw nothing; a class with fewer rows than a cell wants is an error."""
    keys = [c for c in ("client", "t", "concept") if c in counts.columns]
    if not keys:
        raise ValueError("counts need a client, t or concept")
    wanted = grid.join(counts.where("n > 0").select(*keys, "label", "n"), keys)
    pool = pool if weight is None else pool.where(F.col(weight) > 0)
    sizes = pool.groupBy("label").agg(F.count("*").alias("rows"))
    # how many cells one epoch of a class serves
    serves = wanted.groupBy("label").agg(F.max("n").alias("most"), F.count("*").alias("cells")).join(sizes, "label", "left")
    short = F.raise_error(F.format_string("class %s has fewer rows than a cell draws", F.col("label").cast("string")))
    serves = serves.withColumn("slots", F.when(F.coalesce("rows", F.lit(0)) < F.col("most"), short.cast("long")).otherwise(F.floor(F.col("rows") / F.col("most")) if weight is None else F.lit(1)))
    serves = stored(serves.select("label", "most", "slots", F.ceil(F.col("cells") / F.col("slots")).alias("epochs")), "pool-classes")

    cells = numbered(wanted, ["label"], hash_unit(F.lit(seed), "client", "t"), ["client", "t"]).join(serves, "label")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    places = cells.select("client", "t", "concept", "label", F.floor(F.col("nth") / F.col("slots")).alias("epoch"), (F.col("nth") % F.col("slots") * F.col("most")).alias("first"), at.alias("i"))
    places = places.select("client", "t", "concept", "label", "epoch", (F.col("first") + F.col("i")).alias("nth"))

    epochs = pool.join(serves.select("label", "epochs"), "label").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    unit = hash_unit(F.lit(seed), "epoch", "row_id")
    # 1 - exp(-key): orders like the exponential key and stays in [0, 1)
    unit = unit if weight is None else 1 - F.pow(1 - unit, 1 / F.col(weight))
    ordered = numbered(epochs, ["label", "epoch"], unit, ["row_id"]).select("label", "epoch", "nth", "row_id")
    return places.join(ordered, ["label", "epoch", "nth"]).select("client", "t", "concept", "label", "row_id")
