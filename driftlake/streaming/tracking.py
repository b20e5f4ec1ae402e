"""Concept tracking with memory: per-client libraries and the shared memory bank.

Libraries are bounded by their capacity; the state of a client is its library."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftlake.operators.solvers import cosine


@dataclass
class Slot:
    slot_id: int
    mean: np.ndarray
    count: float = 1.0
    recurrence: float = 1.0
    last_seen: int = 0

    def absorb(self, vector: np.ndarray, count: float = 1.0) -> None:
        self.mean = (self.mean * self.count + vector * count) / (self.count + count)
        self.count += count


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return (cosine(a, b) + 1) / 2


@dataclass
class Tracker:
    """A client's library: on drift the batch is matched to a known concept or registered as a new one."""

    threshold: float = 0.8
    slots: list[Slot] = field(default_factory=list)
    active: int = -1

    def observe(self, vector: np.ndarray, drifted: bool, t: int) -> tuple[int, bool]:
        """(active concept, whether it is new)."""
        if self.active >= 0 and not drifted:
            self.slots[self.active].absorb(vector)
            return self.active, False
        sims = [similarity(s.mean, vector) for s in self.slots]
        best = int(np.argmax(sims)) if sims else -1
        new = best < 0 or sims[best] < self.threshold
        if new:
            self.slots.append(Slot(len(self.slots), vector.astype(float)))
            best = len(self.slots) - 1
        else:
            self.slots[best].absorb(vector)
            self.slots[best].recurrence += 1
        self.slots[best].last_seen = t
        self.active = best
        return best, new


@dataclass
class MemoryBank:
    """Shared slots with a life cycle: spawn or absorb at the cap, merge alike ones, drop rare ones, fade."""

    capacity: int = 20
    merge_at: float = 0.98
    least_count: float = 2.0
    fade: float = 0.995
    every: int = 5
    slots: dict[int, Slot] = field(default_factory=dict)
    next_id: int = 0
    rounds: int = 0

    def best(self, vector: np.ndarray) -> tuple[int, float]:
        """The most similar slot, the smallest id among equals."""
        found = (-1, -math.inf)
        for i in sorted(self.slots):
            s = similarity(self.slots[i].mean, vector)
            if s > found[1]:
                found = (i, s)
        return found

    def spawn(self, vector: np.ndarray, count: float = 1.0) -> int:
        if len(self.slots) >= self.capacity:
            at, _ = self.best(vector)
            self.slots[at].absorb(vector, count)
            return at
        self.slots[self.next_id] = Slot(self.next_id, vector.astype(float), count)
        self.next_id += 1
        return self.next_id - 1

    def absorb(self, slot: int, vector: np.ndarray, count: float = 1.0) -> None:
        self.slots[slot].absorb(vector, count)
        self.slots[slot].recurrence += 1

    def merge(self) -> dict[int, int]:
        """Merges later slots into earlier alike ones, in order of ids; returns old -> new."""
        moved: dict[int, int] = {}
        for i in sorted(self.slots):
            if i in moved:
                continue
            for j in sorted(self.slots):
                if j <= i or j in moved:
                    continue
                if similarity(self.slots[i].mean, self.slots[j].mean) >= self.merge_at:
                    self.slots[i].absorb(self.slots[j].mean, self.slots[j].count)
                    moved[j] = i
        for j in moved:
            del self.slots[j]
        return moved

    def shrink(self) -> list[int]:
        """Drops slots of few observations, but never the largest."""
        if not self.slots:
            return []
        keep = max(self.slots, key=lambda i: (self.slots[i].count, -i))
        gone = [i for i in sorted(self.slots) if i != keep and self.slots[i].count < self.least_count]
        for i in gone:
            del self.slots[i]
        return gone

    def step(self) -> tuple[dict[int, int], list[int]]:
        self.rounds += 1
        for s in self.slots.values():
            s.recurrence *= self.fade
        if self.rounds % self.every:
            return {}, []
        return self.merge(), self.shrink()

    def assign(self, vector: np.ndarray, novelty: float) -> tuple[int, bool]:
        at, s = self.best(vector)
        if at < 0 or s < novelty:
            return self.spawn(vector), True
        self.absorb(at, vector)
        return at, False


@dataclass
class PersistentIds:
    """Carries ids over rounds: local clusters, in order, take the best unused stored one or a new id."""

    threshold: float = 0.7
    keep: float = 0.7
    stored: dict[int, np.ndarray] = field(default_factory=dict)

    def match(self, centres: dict[int, np.ndarray]) -> dict[int, int]:
        used: set[int] = set()
        out = {}
        for local in sorted(centres):
            v = centres[local]
            sims = {i: cosine(v, s) for i, s in self.stored.items() if i not in used}
            best = max(sims, key=lambda i: (sims[i], -i), default=None)
            if best is None or sims[best] < self.threshold:
                best = max(self.stored, default=-1) + 1
                self.stored[best] = v.astype(float)
            else:
                self.stored[best] = self.keep * self.stored[best] + (1 - self.keep) * v
            used.add(best)
            out[local] = best
        return out


def track(batches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(client, t, concept, is_new) from (client, t, vector, drifted): one sorted pass a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tracker = None, None
        for part in parts:
            out = []
            for r in part.itertuples():
                if tracker is None or r.client != client:
                    client, tracker = r.client, Tracker(threshold)
                out.append((r.client, r.t, *tracker.observe(np.asarray(r.vector, float), bool(r.drifted), r.t)))
            yield pd.DataFrame(out, columns=["client", "t", "concept", "is_new"])

    rows = batches.select(F.col("client").cast("long"), F.col("t").cast("long"), "vector", "drifted")
    return rows.repartition("client").sortWithinPartitions("client", "t").mapInPandas(run, "client long, t long, concept long, is_new boolean")


def track_stream(batches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same over a stream, with the client's library as state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(threshold)
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        out = [(r.client, r.t, *tracker.observe(np.asarray(r.vector, float), bool(r.drifted), r.t)) for r in rows.itertuples()]
        state.update((pickle.dumps(tracker),))
        yield pd.DataFrame(out, columns=["client", "t", "concept", "is_new"])

    rows = batches.select(F.col("client").cast("long"), F.col("t").cast("long"), "vector", "drifted")
    return rows.groupBy("client").applyInPandasWithState(run, "client long, t long, concept long, is_new boolean", "tracker binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time counts by kind with a watermark; the same plan for tables and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
