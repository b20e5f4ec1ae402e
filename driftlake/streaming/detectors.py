"""Drift detectors over one client's values, in order.

Each is a small object with ``update(value) -> bool`` and bounded state, so the
same code serves batches (a sorted pass) and streams (state per client).

* Adwin: adaptive windowing with exponential buckets (Bifet and Gavalda, 2007).
* PageHinkley: cumulative deviation from the running mean (Page, 1954; Hinkley, 1971).
* Kswin: Kolmogorov-Smirnov test of the latest values against a sample of the
  window before them (Raab, Heusinger and Schleif, 2020), with a seed."""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftlake.operators.solvers import ks_distance, ks_p_value


class Detector:
    """The interface: ``update``, ``reset`` and ``clone`` (a fresh detector of the same settings)."""

    def __init__(self, **settings: Any):
        self.settings = settings
        self.reset()

    def reset(self) -> None:
        raise NotImplementedError

    def update(self, value: float) -> bool:
        raise NotImplementedError

    def clone(self) -> Detector:
        return type(self)(**self.settings)


class Never(Detector):
    def reset(self) -> None:
        pass

    def update(self, value: float) -> bool:
        return False


class Adwin(Detector):
    """Cuts the window where two parts' means differ by more than chance allows at ``delta`` (Bifet and Gavalda, 2007).

    Every ``every``-th value the window is looked at, if it holds more than ``grace``; neither part may be shorter than ``least``."""

    def __init__(self, delta: float = 0.002, per_row: int = 5, every: int = 32, least: int = 5, grace: int = 10):
        super().__init__(delta=delta, per_row=per_row, every=every, least=least, grace=grace)

    def reset(self) -> None:
        # rows[i] holds (sum, variance sum) of buckets of 2**i values, oldest first
        self.rows: list[deque] = [deque()]
        self.n, self.seen = 0, 0

    def _total(self) -> tuple[float, float]:
        """Sum and variance sum of the window, merged over all buckets."""
        n, s, v = 0, 0.0, 0.0
        for i, row in enumerate(self.rows):
            for bs, bv in row:
                size = 1 << i
                if n:
                    gap = s / n - bs / size
                    v += bv + n * size / (n + size) * gap * gap
                else:
                    v = bv
                n, s = n + size, s + bs
        return s, v

    def update(self, value: float) -> bool:
        self.rows[0].append((float(value), 0.0))
        self.n += 1
        self.seen += 1
        for i in range(64):
            if i == len(self.rows) or len(self.rows[i]) <= self.settings["per_row"]:
                break
            (s1, v1), (s2, v2) = self.rows[i].popleft(), self.rows[i].popleft()
            if i + 1 == len(self.rows):
                self.rows.append(deque())
            size = 1 << i
            self.rows[i + 1].append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * size)))
        if self.seen % self.settings["every"] or self.n <= self.settings["grace"]:
            return False
        found = False
        while self._shrink():
            found = True
        return found

    def _shrink(self) -> bool:
        total, spread = self._total()
        n, least = self.n, self.settings["least"]
        if n < 2 * least:
            return False
        variance = spread / n
        log = math.log(2 * math.log(n) / self.settings["delta"])
        n0, s0 = 0, 0.0
        for i in range(len(self.rows) - 1, -1, -1):
            for bs, _ in self.rows[i]:
                n0, s0 = n0 + (1 << i), s0 + bs
                n1 = n - n0
                if n1 < least:
                    return False
                if n0 < least:
                    continue
                part = 1 / (n0 - least + 1) + 1 / (n1 - least + 1)
                limit = math.sqrt(2 * part * variance * log) + 2 / 3 * part * log
                if abs(s0 / n0 - (total - s0) / n1) > limit:
                    oldest = max(j for j, row in enumerate(self.rows) if row)
                    self.rows[oldest].popleft()
                    self.n -= 1 << oldest
                    return True
        return False


class PageHinkley(Detector):
    """Fires when values rise (or fall) from their running mean by more than ``threshold`` in sum."""

    def __init__(self, least: int = 30, delta: float = 0.005, threshold: float = 50.0, both: bool = True):
        super().__init__(least=least, delta=delta, threshold=threshold, both=both)

    def reset(self) -> None:
        self.n, self.mean, self.up, self.low, self.down, self.high = 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def update(self, value: float) -> bool:
        self.n += 1
        self.mean += (value - self.mean) / self.n
        gap = value - self.mean
        self.up += gap - self.settings["delta"]
        self.low = min(self.low, self.up)
        self.down += gap + self.settings["delta"]
        self.high = max(self.high, self.down)
        if self.n < self.settings["least"]:
            return False
        fired = self.up - self.low > self.settings["threshold"] or (self.settings["both"] and self.high - self.down > self.settings["threshold"])
        if fired:
            self.reset()
        return fired


class Kswin(Detector):
    def __init__(self, alpha: float = 0.005, window: int = 100, latest: int = 30, seed: int = 0):
        super().__init__(alpha=alpha, window=window, latest=latest, seed=seed)

    def reset(self) -> None:
        self.values: deque = deque(maxlen=self.settings["window"])
        self.rng = np.random.default_rng(self.settings["seed"])

    def update(self, value: float) -> bool:
        self.values.append(float(value))
        if len(self.values) < self.settings["window"]:
            return False
        k = self.settings["latest"]
        values = np.array(self.values)
        new, old = values[-k:], self.rng.choice(values[:-k], k, replace=False)
        distance = ks_distance(new, old)
        if distance > 0.1 and ks_p_value(distance, k, k) < self.settings["alpha"]:
            self.values = deque(new, maxlen=self.settings["window"])
            return True
        return False


DETECTORS: dict[str, Callable[..., Detector]] = {"adwin": Adwin, "page_hinkley": PageHinkley, "kswin": Kswin, "none": Never}


def detect(values: DataFrame, name: str, **settings: Any) -> DataFrame:
    """(client, seq) at which a detector fires, from (client, seq, value) in batch.

    Rows are placed by client and sorted, and each partition is one pass over sorted
    rows: a client's state is all that is held, however long its series."""
    make = DETECTORS[name]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, detector = None, None
        for part in parts:
            fired = np.zeros(len(part), bool)
            clients = part["client"].to_numpy()
            for i, (c, v) in enumerate(zip(clients, part["value"].to_numpy(), strict=True)):
                if detector is None or c != client:
                    client, detector = c, make(**settings)
                if not math.isnan(v):
                    fired[i] = detector.update(v)
            yield part.loc[fired, ["client", "seq"]]

    rows = values.select(F.col("client").cast("long"), F.col("seq").cast("long"), F.col("value").cast("double")).where("client is not null")
    return rows.repartition("client").sortWithinPartitions("client", "seq").mapInPandas(run, "client long, seq long")


def detect_stream(values: DataFrame, name: str, **settings: Any) -> DataFrame:
    """The same over a stream; values of a client are taken in order within each batch of the stream."""
    make = DETECTORS[name]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else make(**settings)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        fired = [detector.update(v) if not math.isnan(v) else False for v in rows["value"]]
        state.update((pickle.dumps(detector),))
        yield rows.loc[fired, ["client", "seq"]]

    rows = values.select(F.col("client").cast("long"), F.col("seq").cast("long"), F.col("value").cast("double"))
    return rows.groupBy("client").applyInPandasWithState(run, "client long, seq long", "detector binary", "append", GroupStateTimeout.NoTimeout)


def page_hinkley_statistic(values: DataFrame, delta: float = 0.005) -> DataFrame:
    """(client, seq, statistic) without restarts, by windows alone: the cumulative deviation above its running minimum."""
    w = Window.partitionBy("client").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.withColumn("gap", F.col("value") - F.avg("value").over(w) - delta)
    rows = rows.withColumn("up", F.sum("gap").over(w))
    return rows.select("client", "seq", (F.col("up") - F.least(F.lit(0.0), F.min("up").over(w))).alias("statistic"))
