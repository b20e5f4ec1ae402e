"""The format drift: generated, written, read back, and nothing left of a failed write."""

import pytest
from pyspark.sql import functions as F

from driftlake.sources import datasource, generators

ORDER = ["client", "t", "row_id"]


def generated(spark, **options):
    datasource.register(spark)
    reader = spark.read.format("drift")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def rows_of(df):
    return [tuple(r) for r in df.select("client", "t", "gt", "row_id", "x", "y").orderBy(*ORDER).collect()]


def test_generated_as_the_generators(spark):
    got = generated(spark, clients=70, steps=4, samples=3, seed=5, kind="sea")
    assert got.rdd.getNumPartitions() == 2
    c = generators.GeneratorConfig(clients=70, steps=4, n_samples=3, seed=5, kind="sea")
    grid = generators.concept_grid(spark, c)
    want = generators.samples(grid, c).join(grid, ["client", "t"]).withColumn("y", F.col("y").cast("double"))
    assert rows_of(got) == rows_of(want)


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = generated(spark, clients=5, steps=3, samples=4)
    rows.repartition(3).write.format("drift").option("seed", 42).mode("append").save(path)
    back = lambda: spark.read.format("drift").load(path)
    assert rows_of(back()) == rows_of(rows)
    made = datasource.read_manifest(path)
    assert made["options"] == {"seed": "42"} and sum(f["rows"] for f in made["files"]) == 60
    assert made["concepts"] == sorted(r.gt for r in rows.select("gt").distinct().collect())
    rows.where("client = 1").write.format("drift").mode("append").save(path)
    assert back().count() == 72
    rows.where("client = 2").write.format("drift").mode("overwrite").save(path)
    assert rows_of(back()) == rows_of(rows.where("client = 2"))
    assert len(list(tmp_path.glob("data/part-*"))) == len(datasource.read_manifest(path)["files"])
    rows.limit(0).write.format("drift").mode("overwrite").save(path)
    assert back().count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = generated(spark, clients=6, steps=2, samples=2)
    rows.write.format("drift").mode("append").save(path)
    before, files = rows_of(spark.read.format("drift").load(path)), sorted(p.name for p in tmp_path.glob("data/*"))
    bad = rows.repartition(4, "client").withColumn("y", F.when(F.col("client") == 3, F.raise_error("lost").cast("double")).otherwise(F.col("y")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            bad.write.format("drift").mode(mode).save(path)
    assert rows_of(spark.read.format("drift").load(path)) == before and sorted(p.name for p in tmp_path.glob("data/*")) == files
    with pytest.raises(Exception, match="needs the columns"):
        rows.drop("gt").write.format("drift").mode("append").save(path)
