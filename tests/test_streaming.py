"""Detectors on still and shifted series, and streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.streaming import detectors, tracking


def test_adwin():
    still = detectors.Adwin()
    assert not any(still.update(0.0) for _ in range(100))
    moved = detectors.Adwin(delta=0.01)
    assert not any(moved.update(0.0) for _ in range(200)) and any(moved.update(1.0) for _ in range(200))
    noisy = detectors.Adwin()
    rng = np.random.default_rng(0)
    assert not any(noisy.update(v) for v in rng.random(3000))


def plain_adwin(values, delta, every, least, grace):
    """The window itself with every cut tried, buckets of one value: an upper bound on what buckets can find."""
    window, fired = [], []
    for i, v in enumerate(values):
        window.append(v)
        if (i + 1) % every or len(window) <= grace:
            continue
        cut = True
        while cut and len(window) >= 2 * least:
            n, cut = len(window), False
            log = np.log(2 * np.log(n) / delta)
            for k in range(least, n - least + 1):
                part = 1 / (k - least + 1) + 1 / (n - k - least + 1)
                if abs(np.mean(window[:k]) - np.mean(window[k:])) > np.sqrt(2 * part * np.var(window) * log) + 2 / 3 * part * log:
                    window, cut = window[1:], True
                    fired.append(i)
                    break
    return sorted(set(fired))


def test_adwin_value_by_value():
    """With rows of buckets so long that none is merged, ADWIN is the plain window."""
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 0.3, 90), rng.normal(1, 0.3, 60), rng.normal(-1, 0.3, 70)])
    for least, grace, every in ((5, 10, 8), (3, 40, 16), (9, 1, 4)):
        d = detectors.Adwin(delta=0.05, per_row=10_000, every=every, least=least, grace=grace)
        fired = [i for i, v in enumerate(values) if d.update(v)]
        assert fired == plain_adwin(values, 0.05, every, least, grace) and fired


def test_reset_and_clone():
    d = detectors.Adwin(delta=0.01)
    d.update(1.0)
    d.reset()
    assert not d.update(0.0) and d.clone().settings == d.settings


def test_page_hinkley_and_kswin():
    rng = np.random.default_rng(1)
    for make in (lambda: detectors.PageHinkley(threshold=10), detectors.Kswin):
        d = make()
        before = [d.update(v) for v in rng.normal(0, 0.1, 150)]
        after = [d.update(v) for v in rng.normal(2, 0.1, 150)]
        assert sum(before) == 0 and any(after)
    assert not any(detectors.Never().update(v) for v in range(50))


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    rows = [(c, i, float(rng.normal(0 if i < 120 or c == 0 else 3, 0.2))) for c in range(3) for i in range(260)]
    return spark.createDataFrame(rows, "client long, seq long, value double")


def run_stream(spark, frame, build, tmp_path, files=3):
    path = str(tmp_path / "in")
    frame.repartitionByRange(files, frame.columns[1]).write.parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 100).parquet(path)
    name = f"out_{abs(hash(path))}"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("name", ["adwin", "page_hinkley", "kswin"])
def test_stream_equals_batch(spark, values, tmp_path, name):
    settings = {"threshold": 10.0} if name == "page_hinkley" else {}
    batch = sorted(map(tuple, detectors.detect(values, name, **settings).collect()))
    assert {c for c, _ in batch} == {1, 2}
    assert run_stream(spark, values, lambda s: detectors.detect_stream(s, name, **settings), tmp_path) == batch


def test_page_hinkley_by_windows(spark, values):
    found = detectors.page_hinkley_statistic(values).where("statistic > 50").groupBy("client").agg(F.min("seq").alias("at")).collect()
    assert {r.client for r in found} == {1, 2} and all(r["at"] > 120 for r in found)


def test_tracker(spark, tmp_path):
    a, b = [1.0, 0.0], [-1.0, 0.2]
    rows = [(0, t, a if t in (0, 1, 4) else b, t in (2, 4)) for t in range(6)]
    frame = spark.createDataFrame(rows, "client long, t long, vector array<double>, drifted boolean")
    batch = sorted(map(tuple, tracking.track(frame).collect()))
    assert [r[2] for r in batch] == [0, 0, 1, 1, 0, 0] and [r[3] for r in batch] == [True, False, True, False, False, False]
    assert run_stream(spark, frame, tracking.track_stream, tmp_path, 1) == batch


def test_memory_bank():
    bank = tracking.MemoryBank(capacity=2, every=1, merge_at=0.999, least_count=1.5)
    a, b, c = np.array([1.0, 0]), np.array([0, 1.0]), np.array([1.0, 0.01])
    assert bank.assign(a, 0.9) == (0, True) and bank.assign(b, 0.9) == (1, True)
    assert bank.assign(c, 0.9) == (0, False) and bank.spawn(np.array([0.1, 1.0])) == 1
    bank.slots[2] = tracking.Slot(2, a.copy(), 5.0)
    assert bank.step() == ({2: 0}, []) and set(bank.slots) == {0, 1}


def test_persistent_ids():
    ids = tracking.PersistentIds()
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    assert ids.match({0: a, 1: b}) == {0: 0, 1: 1}
    assert ids.match({0: b, 1: a}) == {0: 1, 1: 0}
    assert ids.match({0: -a}) == {0: 2}


def test_windows_with_watermark(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.mean) for r in tracking.windowed_counts(events).collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]
