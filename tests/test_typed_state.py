"""Streams with typed state: rows out of order give what the batch gives, and state is read back by column."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.streaming import detectors, typed


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, typed.PROVIDER)
    yield
    spark.conf.set(key, before)


def test_rows_out_of_order(spark, tmp_path, rocks):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(c, i, float(rng.normal(0 if i < 80 or c == 0 else 3 if c == 1 else -3, 0.2)), start + dt.timedelta(minutes=i)) for c in range(3) for i in range(160)]
    schema = "client long, seq long, value double, ts timestamp"
    batch = sorted(map(tuple, detectors.detect(spark.createDataFrame(rows, schema), "page_hinkley", threshold=10.0).collect()))
    assert batch
    # shuffled within half an hour, over four files and a last one that lets the watermark pass all
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, 25))
    mixed = [rows[i] for i in order]
    path = str(tmp_path / "in")
    ends = [(99, 0, 0.0, start + dt.timedelta(days=2))]
    for part in (mixed[:120], mixed[120:240], mixed[240:360], mixed[360:], ends, [(99, 1, 0.0, start + dt.timedelta(days=3))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = typed.page_hinkley_stream(stream, "ts", "30 minutes", threshold=10.0).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch
    state = spark.read.format("statestore").option("stateVarName", "statistic").load(str(tmp_path / "check"))
    got = {r[0]: r[1] for r in state.select("key.client", "value.n").collect()}
    assert set(got) >= {0, 1, 2} and got[0] == 160
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(str(tmp_path / "check"))
    assert waiting.where("key.client < 99").count() == 0


def test_the_store_is_asked_for(spark):
    rows = spark.createDataFrame([(0, 0, 0.0)], "client long, seq long, value double").withColumn("ts", F.current_timestamp())
    with pytest.raises(RuntimeError, match="providerClass"):
        typed.page_hinkley_stream(rows, "ts", "1 minute")
