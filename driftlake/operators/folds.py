"""Cross-validated nearest-centroid accuracy in one pass: a fold's statistics are taken from the totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.functions import vectors as V


def fold_centroids(rows: DataFrame, concept: str, label: str, fold: str, vector: str = "x") -> DataFrame:
    """(concept, fold, label, centroid): the class's mean over the concept's other folds; classes without rows there are absent."""
    sums = rows.select(concept, label, fold, F.posexplode(vector).alias("i", "v")).groupBy(concept, label, fold, "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    own = sums.groupBy(concept, label, fold).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("s"))
    total = sums.groupBy(concept, label, "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = total.groupBy(concept, label).agg(F.max("n").alias("all_n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("all_s"))
    folds = rows.select(concept, fold).distinct()
    # a class that a fold lacks keeps its total
    both = folds.join(total, concept).join(own, [concept, label, fold], "left")
    rest = F.col("all_n") - F.coalesce("n", F.lit(0))
    left = F.when(F.col("s").isNull(), F.col("all_s")).otherwise(F.zip_with("all_s", "s", lambda x, y: x - y))
    return both.where(rest > 0).select(concept, fold, label, F.transform(left, lambda x: x / rest).alias("centroid"))


def nearest_centroid_accuracy(rows: DataFrame, concept: str, label: str, key: str, folds: int = 5, vector: str = "x", fold: Column | None = None) -> DataFrame:
    """(concept, n, accuracy): share of rows whose nearest centroid of the other folds is their class's, the smallest label among equals.

    A row meets the classes of its concept only. Rows without any centroid count as wrong."""
    placed = rows.withColumn("_fold", F.pmod(F.col(key), F.lit(folds)) if fold is None else fold)
    centroids = fold_centroids(placed, concept, label, "_fold", vector).withColumnRenamed(label, "_class")
    met = placed.join(centroids, [concept, "_fold"], "left").select(concept, key, label, F.struct(F.round(V.square_distance(vector, "centroid"), 9).alias("d"), "_class").alias("found"))
    nearest = met.groupBy(concept, key, label).agg(F.min(F.when(F.col("found._class").isNotNull(), F.col("found"))).alias("found"))
    right = F.coalesce(F.col("found._class") == F.col(label), F.lit(False)).cast("double")
    return nearest.groupBy(concept).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
