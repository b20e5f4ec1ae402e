"""Page-Hinkley over streams with typed state: rows out of order are put in order first.

The state of a client is columns, not an object: a value state with the statistic, and a list of
rows that wait. A row waits until the watermark has passed it, so rows of several micro-batches
are taken in order of time; a timer wakes a client whose rows have become due without new ones.
Rows later than the watermark allows are dropped by Spark. The result equals the batch operator's
over the rows that were in time, and the state can be read back by column
(``spark.read.format("statestore")``, ``stateVarName`` "statistic" or "waiting").

The stream's session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATISTIC = StructType([StructField("n", LongType()), StructField("mean", DoubleType()), StructField("up", DoubleType()), StructField("low", DoubleType()), StructField("down", DoubleType()), StructField("high", DoubleType())])
NEW = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
WAITING = StructType([StructField("at", LongType()), StructField("seq", LongType()), StructField("value", DoubleType())])
OUT = StructType([StructField("client", LongType()), StructField("seq", LongType())])


class PageHinkleyProcessor(StatefulProcessor):
    """Cumulative deviation from the running mean above its minimum (and, for ``both``, below its maximum), restarted when it passes ``threshold``."""

    def __init__(self, delta: float, threshold: float, least: int, both: bool):
        self.delta, self.threshold, self.least, self.both = delta, threshold, least, both

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.statistic = handle.getValueState("statistic", STATISTIC)
        self.waiting = handle.getListState("waiting", WAITING)

    def _step(self, state: tuple, value: float) -> tuple[tuple, bool]:
        n, mean, up, low, down, high = state
        n += 1
        mean += (value - mean) / n
        up, down = up + value - mean - self.delta, down + value - mean + self.delta
        low, high = min(low, up), max(high, down)
        if n >= self.least and (up - low > self.threshold or (self.both and high - down > self.threshold)):
            return NEW, True
        return (n, mean, up, low, down, high), False

    def _due(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark has passed, in order; the others wait on."""
        rows.sort()
        due = [r for r in rows if r[0] <= watermark]
        left = rows[len(due) :]
        if due:
            state = tuple(self.statistic.get()) if self.statistic.exists() else NEW
            fired = []
            for _, seq, value in due:
                if not math.isnan(value):
                    state, found = self._step(state, value)
                    if found:
                        fired.append(seq)
            self.statistic.update(state)
            if fired:
                yield pd.DataFrame({"client": [key[0]] * len(fired), "seq": fired})
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0])
        else:
            self.waiting.clear()

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            held += [(int(a), int(s), float(v)) for a, s, v in zip(part["at"], part["seq"], part["value"], strict=True)]
        yield from self._due(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._due(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def page_hinkley_stream(values: DataFrame, time: str, late: str, delta: float = 0.005, threshold: float = 50.0, least: int = 30, both: bool = True) -> DataFrame:
    """(client, seq) at which the detector fires, from a stream (client, seq, value, ``time``).

    Rows of a client are taken by ``time``, then ``seq``; those more than ``late`` behind the newest are dropped."""
    conf = values.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not conf.endswith("RocksDBStateStoreProvider"):
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = values.withWatermark(time, late).select(F.col("client").cast("long").alias("client"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("value").cast("double"), F.lit(math.nan)).alias("value"), F.unix_millis(time).alias("at"), time)
    return rows.where("client is not null").groupBy("client").transformWithStateInPandas(PageHinkleyProcessor(delta, threshold, least, both), OUT, "Append", "EventTime")
