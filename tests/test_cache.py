"""Stored results are found by plan and inputs, and only whole."""

import pytest
from pyspark.sql import functions as F

from driftlake.sources import cache


def jobs(spark, f):
    group = f"cache-{id(f)}"
    spark.sparkContext.setJobGroup(group, group)
    f()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    return len(found)


def features(spark, sf_dir, power=2):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.sum(F.pow("vec_id", F.lit(power))).alias("s"))


def test_second_read_makes_no_job_on_sources(spark, sf_dir, tmp_path):
    folder = str(tmp_path)
    first = cache.cached(features(spark, sf_dir), folder)
    again = features(spark, sf_dir)  # a new frame with other column ids
    assert cache.cache_key(again) == cache.cache_key(features(spark, sf_dir))
    held = []
    assert jobs(spark, lambda: held.append(cache.cached(again, folder))) == 0
    assert sorted(held[0].collect()) == sorted(first.collect()) == sorted(again.collect())
    assert held[0].schema.names == again.schema.names
    assert len(list(tmp_path.iterdir())) == 1
    cache.cached(features(spark, sf_dir, 3), folder)
    cache.cached(again, folder, version="2")
    assert len(list(tmp_path.iterdir())) == 3


def test_wide_plans_are_told_apart(spark):
    wide = lambda last: spark.range(3).select(*[(F.col("id") + (i if i < 59 else last)).alias(f"c{i}") for i in range(60)])
    assert cache.cache_key(wide(1)) != cache.cache_key(wide(2)) and cache.cache_key(wide(1)) == cache.cache_key(wide(1))


def test_changed_inputs_are_read_anew(spark, tmp_path):
    data, folder = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(5).write.parquet(data)
    made = lambda: cache.cached(spark.read.parquet(data).agg(F.sum("id").alias("s")), folder)
    assert made().first().s == 10
    spark.range(5, 7).write.mode("append").parquet(data)
    assert made().first().s == 21


def test_torn_results_are_refused(spark, sf_dir, tmp_path):
    df, folder = features(spark, sf_dir), str(tmp_path)
    want = sorted(cache.cached(df, folder).collect())
    path = next(tmp_path.iterdir())
    part = next(path.glob("data-*/part-*"))
    part.unlink()
    with pytest.raises(cache.TornResult, match="manifest"):
        cache.read_result(spark, str(path))
    assert sorted(cache.cached(df, folder).collect()) == want
    (path / cache.MANIFEST).unlink()
    with pytest.raises(cache.TornResult, match="no manifest"):
        cache.read_result(spark, str(path))
    assert sorted(cache.cached(df, folder).collect()) == want
