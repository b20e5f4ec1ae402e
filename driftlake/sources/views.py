"""The canonical long-form tables, derived from whatever tables a caller has.

Schemas (one row per line of the data model):

* grid: client, t, gt, pred, acc
* params: client, concept, idx, val, weight (model parameters in long form)
* samples: client, t, row_id, x, y
* sweep: method, axis, seed, setting, value
* budget: method, federation_every, total_bytes, accuracy_auc
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid from events: the client is the user, t its event's position, the concept its type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # event types are a dimension: one row each, numbered in one small task
    kinds = events.select("event_type").distinct().withColumn("gt", F.row_number().over(Window.orderBy("event_type")).cast("long") - 1)
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    pred = F.when(F.col("event_id") % 10 < 7, (F.col("gt") * 2 + 1) % 5).otherwise((F.col("event_id") * 7) % 5)
    return events.join(kinds, "event_type").select(F.col("user_id").alias("client"), t.alias("t"), "gt", pred.alias("pred"), F.col("value").alias("acc"))


GRID_SQL = """
kinds AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS gt FROM (SELECT DISTINCT event_type FROM events)
), grid AS (
  SELECT user_id AS client, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, gt,
         CASE WHEN event_id % 10 < 7 THEN (gt * 2 + 1) % 5 ELSE (event_id * 7) % 5 END AS pred, value AS acc
  FROM events JOIN kinds USING (event_type)
)"""


def vector_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model parameters from embeddings: one client a vector, its label as concept."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("client"), F.col("label").cast("long").alias("concept"), (F.col("vec_id") % 7 + 1).cast("double").alias("weight"), F.posexplode("embedding").alias("idx", "val"))
    return rows.select("client", "concept", "weight", F.col("idx").cast("long").alias("idx"), F.col("val").cast("double").alias("val"))


PARAMS_SQL = """
params AS (
  SELECT vec_id AS client, CAST(label AS BIGINT) AS concept, CAST(vec_id % 7 + 1 AS DOUBLE) AS weight,
         unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS val
  FROM embeddings
)"""


def vector_samples(spark: SparkSession, sf_dir: str, clients: int = 10, steps: int = 5) -> DataFrame:
    """Samples from embeddings: client and t from the vector's number."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") % clients).alias("client"), (F.floor(F.col("vec_id") / clients) % steps).alias("t"), F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("long").alias("y"))


SAMPLES_SQL = """
samples AS (
  SELECT vec_id % 10 AS client, (vec_id // 10) % 5 AS t, vec_id AS row_id,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(label AS BIGINT) AS y
  FROM embeddings
)"""


def order_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep table from line items: method from flag and status, axis from the quantity, setting from the supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "l_discount", "l_orderkey")
    return rows.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("method"),
        (F.floor(F.col("l_quantity") / 10)).cast("long").alias("axis"),
        (F.col("l_suppkey") % 12).alias("setting"),
        (F.col("l_orderkey") % 3).alias("seed"),
    ).agg(F.round(F.avg("l_discount"), 6).alias("value"))


SWEEP_SQL = """
sweep AS (
  SELECT l_returnflag || l_linestatus AS method, CAST(floor(l_quantity / 10) AS BIGINT) AS axis,
         l_suppkey % 12 AS setting, l_orderkey % 3 AS seed, round(avg(l_discount), 6) AS value
  FROM lineitem GROUP BY 1, 2, 3, 4
)"""


def order_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget points from orders: method from the priority, cadence from the month."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return rows.groupBy(F.col("o_orderpriority").alias("method"), F.month("o_orderdate").cast("long").alias("federation_every")).agg(
        F.round(F.sum("o_totalprice") / 1000, 2).alias("total_bytes"), F.round(F.avg(F.col("o_orderkey") % 100) / 10, 6).alias("accuracy_auc")
    )


BUDGET_SQL = """
budget AS (
  SELECT o_orderpriority AS method, CAST(month(o_orderdate) AS BIGINT) AS federation_every,
         round(sum(o_totalprice) / 1000, 2) AS total_bytes, round(avg(o_orderkey % 100) / 10, 6) AS accuracy_auc
  FROM orders GROUP BY 1, 2
)"""
