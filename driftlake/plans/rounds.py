"""Simulation of federated rounds under drift.

A setting (data configuration, method, seed) is one independent run of bounded size
(clients x steps), so settings are what Spark spreads: one row each in, a grid of
(client, t, gt, pred, acc, bytes) out. Inside a run the models are small matrices.

Shared protocol of each step: evaluate every client on the first half of its batch,
train on the second, and every ``federation_every`` steps, but not after the last
one, exchange models and count their bytes."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.operators import solvers
from driftlake.sources.generators import GeneratorConfig, draw, markov
from driftlake.streaming.detectors import Adwin
from driftlake.streaming.tracking import PersistentIds

OUT = "run string, method string, seed long, client long, t long, gt long, pred long, acc double, bytes double"


@dataclass
class Options:
    rate: float = 0.5
    epochs: int = 10
    every: int = 1
    clusters: int = 3
    bits: int = 32
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def get(self, name: str, default: float) -> float:
        return self.extra.get(name, default)


def proba(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ w[:, :-1].T + w[:, -1]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(proba(w, x)[np.arange(len(y)), y], 1e-12)).mean()) if len(y) else math.inf


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = proba(w, x)
    p[np.arange(len(y)), y] -= 1
    return np.hstack([p.T @ x, p.sum(0)[:, None]]) / max(1, len(y))


def fit(w: np.ndarray, x: np.ndarray, y: np.ndarray, o: Options, pull: np.ndarray | None = None, strength: float = 0.0, rate: float | None = None) -> np.ndarray:
    """Full-batch gradient steps, with an optional pull towards another model."""
    for _ in range(o.epochs):
        g = gradient(w, x, y)
        if pull is not None:
            g = g + strength * (w - pull)
        w = w - (o.rate if rate is None else rate) * g
    return w


def mean_of(models: list[np.ndarray], weights: list[float] | np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(models)) if weights is None else np.asarray(weights, float)
    return np.tensordot(w / w.sum(), np.stack(models), 1) if w.sum() > 0 else np.mean(models, 0)


class Method:
    """Local models alone; other methods override what they do otherwise."""

    def __init__(self, clients: int, d: int, classes: int, o: Options):
        self.k, self.d, self.c, self.o = clients, d, classes, o
        self.models = [np.zeros((classes, d + 1)) for _ in range(clients)]
        self.batch: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, d)), np.zeros(0, int))] * clients
        self.assigned = [0] * clients
        self.size = classes * (d + 1)

    def predict(self, i: int, x: np.ndarray) -> np.ndarray:
        return proba(self.models[i], x).argmax(1)

    def train(self, i: int, t: int, x: np.ndarray, y: np.ndarray, gt: int) -> None:
        self.batch[i] = x, y
        self.models[i] = fit(self.models[i], x, y, self.o)

    def federate(self, t: int) -> float:
        return 0.0

    def weights(self) -> list[int]:
        return [len(y) for _, y in self.batch]

    def traffic(self, numbers: float) -> float:
        return numbers * self.o.bits / 8

    def round_trip(self) -> float:
        return self.traffic(2 * self.k * self.size)

    def by_cluster(self, labels: list[int] | np.ndarray, weights=None) -> None:
        """Every client gets the mean of its cluster."""
        w = self.weights() if weights is None else weights
        for c in set(labels):
            own = [i for i in range(self.k) if labels[i] == c]
            m = mean_of([self.models[i] for i in own], [w[i] for i in own])
            for i in own:
                self.models[i] = m.copy()
        self.assigned = [int(c) for c in labels]

    def flat(self) -> np.ndarray:
        return np.stack([m.ravel() for m in self.models])

    def cosine_distance(self, rows: np.ndarray) -> np.ndarray:
        return 1 - np.array([[solvers.cosine(a, b) for b in rows] for a in rows])

    def describe(self, i: int) -> np.ndarray:
        """Mean and deviation of the features, label shares and class means of a client's batch."""
        x, y = self.batch[i]
        shares = np.bincount(y, minlength=self.c) / max(1, len(y))
        means = [x[y == c].mean(0) if (y == c).any() else np.zeros(self.d) for c in range(self.c)]
        return np.concatenate([x.mean(0), x.std(0), shares, *means]) if len(x) else np.zeros(2 * self.d + self.c + self.c * self.d)


class FedAvg(Method):
    def federate(self, t):
        m = mean_of(self.models, self.weights())
        self.models = [m.copy() for _ in range(self.k)]
        return self.round_trip()


class Oracle(Method):
    """One model a true concept."""

    def __init__(self, *a):
        super().__init__(*a)
        self.bank: dict[int, np.ndarray] = {}

    def train(self, i, t, x, y, gt):
        if gt != self.assigned[i] and gt in self.bank:
            self.models[i] = self.bank[gt].copy()
        self.assigned[i] = gt
        super().train(i, t, x, y, gt)

    def federate(self, t):
        self.by_cluster(list(self.assigned))
        self.bank |= {c: m for c, m in zip(self.assigned, self.models, strict=True)}
        return self.round_trip()


class FedProx(FedAvg):
    mu = 0.1

    def __init__(self, *a):
        super().__init__(*a)
        self.shared = np.zeros_like(self.models[0])

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        self.models[i] = fit(self.models[i], x, y, self.o, self.shared, self.o.get("mu", self.mu))

    def federate(self, t):
        out = super().federate(t)
        self.shared = self.models[0]
        return out


class Scaffold(FedAvg):
    """Control variates are exchanged and counted, but do not enter the gradient."""

    def federate(self, t):
        return 2 * super().federate(t)


class AdaptiveFedAvg(FedAvg):
    """The rate follows a running mean of the loss: up where it rises, down where it falls."""

    def __init__(self, *a):
        super().__init__(*a)
        self.trend, self.rates = [None] * self.k, [self.o.rate] * self.k

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        now = loss(self.models[i], x, y)
        if self.trend[i] is not None:
            step = 1.5 if now > 1.1 * self.trend[i] else 0.95
            self.rates[i] = min(1.0, max(1e-5, self.rates[i] * step))
        self.trend[i] = now if self.trend[i] is None else 0.3 * now + 0.7 * self.trend[i]
        self.models[i] = fit(self.models[i], x, y, self.o, rate=self.rates[i])


class CompressedFedAvg(FedProx):
    """Clients send the largest part of their change, ties kept; the rest is carried over."""

    mu = 0.0

    def __init__(self, *a):
        super().__init__(*a)
        self.rest = [np.zeros_like(self.models[0]) for _ in range(self.k)]

    def federate(self, t):
        sent, numbers = [], 0
        for i in range(self.k):
            change = self.models[i] - self.shared + self.rest[i]
            k = max(1, math.ceil(change.size * self.o.get("share", 0.1)))
            keep = np.abs(change) >= np.sort(np.abs(change), axis=None)[-k]
            sent.append(np.where(keep, change, 0))
            self.rest[i] = np.where(keep, 0, change)
            numbers += 2 * int(keep.sum())
        self.shared = self.shared + mean_of(sent, self.weights())
        self.models = [self.shared.copy() for _ in range(self.k)]
        return self.traffic(numbers + self.k * self.size)


class Flash(FedAvg):
    """Where a client's errors drift, some labels come from its old model, and it weighs twice."""

    def __init__(self, *a):
        super().__init__(*a)
        self.detectors, self.drifted = [Adwin() for _ in range(self.k)], [False] * self.k
        self.rng = np.random.default_rng(self.o.seed)

    def train(self, i, t, x, y, gt):
        errors = self.predict(i, x) != y
        self.drifted[i] = any([self.detectors[i].update(float(e)) for e in errors])
        soft = y.copy()
        if self.drifted[i]:
            take = self.rng.random(len(y)) < self.o.get("mix", 0.1)
            soft[take] = self.predict(i, x)[take]
        super().train(i, t, x, soft, gt)

    def weights(self):
        return [w * (2 if f else 1) for w, f in zip(super().weights(), self.drifted, strict=True)]


class FedProto(Method):
    """Class means are exchanged; the nearest one predicts."""

    def __init__(self, *a):
        super().__init__(*a)
        self.sums = np.zeros((self.k, self.c, self.d))
        self.counts = np.zeros((self.k, self.c))
        self.protos = [np.zeros((self.c, self.d)) for _ in range(self.k)]
        self.known = np.zeros((self.k, self.c), bool)

    def predict(self, i, x):
        if not self.known[i].any():
            return np.zeros(len(x), int)
        far = ((x[:, None] - self.protos[i]) ** 2).sum(-1)
        return np.where(self.known[i], far, np.inf).argmin(1)

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        for c in range(self.c):
            self.sums[i, c] += x[y == c].sum(0)
            self.counts[i, c] += (y == c).sum()
        self.protos[i] = self.sums[i] / np.maximum(self.counts[i], 1)[:, None]
        self.known[i] |= self.counts[i] > 0

    def federate(self, t):
        total = self.counts.sum(0)
        shared = self.sums.sum(0) / np.maximum(total, 1)[:, None]
        self.protos = [shared.copy() for _ in range(self.k)]
        self.known[:] = total > 0
        return self.traffic(2 * self.k * self.c * self.d)


class Personal(FedAvg):
    """A shared model and one of each client's own; ``own`` predicts."""

    def __init__(self, *a):
        super().__init__(*a)
        self.own = [m.copy() for m in self.models]

    def predict(self, i, x):
        return proba(self.own[i], x).argmax(1)


class Ditto(Personal):
    def train(self, i, t, x, y, gt):
        anchor = self.models[i]
        super().train(i, t, x, y, gt)
        self.own[i] = fit(self.own[i], x, y, self.o, anchor, self.o.get("pull", 0.5))


class PFedMe(Personal):
    """The own model is a proximal point of the local one, which moves a little towards it."""

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        strength = self.o.get("strength", 15.0)
        self.own[i] = fit(self.models[i], x, y, self.o, self.models[i], strength, rate=min(self.o.rate, 1 / (2 * strength)))
        self.models[i] = self.models[i] - strength * self.o.get("outer_rate", 0.01) * (self.models[i] - self.own[i])


class Apfl(Personal):
    """A mix of own and shared model, whose share is learned."""

    def __init__(self, *a):
        super().__init__(*a)
        self.share = [0.5] * self.k

    def predict(self, i, x):
        return proba(self.share[i] * self.own[i] + (1 - self.share[i]) * self.models[i], x).argmax(1)

    def train(self, i, t, x, y, gt):
        super().train(i, t, x, y, gt)
        self.own[i] = fit(self.own[i], x, y, self.o)
        step = self.o.get("share_rate", 0.1) * (loss(self.models[i], x, y) - loss(self.own[i], x, y))
        self.share[i] = min(1.0, max(0.0, self.share[i] + step))

    def federate(self, t):
        return super().federate(t) + self.traffic(self.k)


class Atp(FedAvg):
    """Models adapt to unlabelled batches by lowering entropy, row by row at learned rates."""

    def __init__(self, *a):
        super().__init__(*a)
        self.rates = np.full((self.k, self.c), 0.01)

    def predict(self, i, x):
        p = proba(self.models[i], x)
        log = np.log(np.maximum(p, 1e-12))
        slope = -p * (log - (p * log).sum(1, keepdims=True))
        g = np.hstack([slope.T @ x, slope.sum(0)[:, None]]) / max(1, len(x))
        return proba(self.models[i] - self.rates[i][:, None] * g, x).argmax(1)

    def train(self, i, t, x, y, gt):
        before = loss(self.models[i], x, y)
        super().train(i, t, x, y, gt)
        self.rates[i] = np.clip(self.rates[i] * (1.1 if loss(self.models[i], x, y) < before else 0.9), 1e-4, 0.5)

    def federate(self, t):
        self.rates[:] = self.rates.mean(0)
        return super().federate(t) + self.traffic(2 * self.k * self.c)


class Clustered(Method):
    """Several shared models."""

    def __init__(self, *a):
        super().__init__(*a)
        rng = np.random.default_rng(self.o.seed)
        self.bank = [rng.normal(size=self.models[0].shape) * 0.01 for _ in range(self.o.clusters)]

    def all_round(self) -> float:
        return self.traffic(self.k * (len(self.bank) + 1) * self.size)


class Ifca(Clustered):
    """Each client takes the shared model of least loss; what it trains is blended half with it."""

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        self.assigned[i] = int(np.argmin([loss(m, x, y) for m in self.bank]))
        base = self.bank[self.assigned[i]]
        self.models[i] = 0.5 * base + 0.5 * fit(base, x, y, self.o)

    def federate(self, t):
        w = self.weights()
        for c in set(self.assigned):
            own = [i for i in range(self.k) if self.assigned[i] == c]
            self.bank[c] = mean_of([self.models[i] for i in own], [w[i] for i in own])
        for i in range(self.k):
            self.models[i] = self.bank[self.assigned[i]].copy()
        return self.all_round()


class FedEm(Clustered):
    """Mixture of shared models with responsibilities from their losses."""

    def __init__(self, *a):
        super().__init__(*a)
        self.mix = np.full((self.k, len(self.bank)), 1 / len(self.bank))
        self.local = [[m.copy() for m in self.bank] for _ in range(self.k)]

    def predict(self, i, x):
        return sum(r * proba(m, x) for r, m in zip(self.mix[i], self.bank, strict=True)).argmax(1)

    def responsibilities(self, i, x, y) -> np.ndarray:
        e = -np.array([loss(m, x, y) for m in self.bank]) + np.log(np.maximum(self.mix[i], 1e-12))
        e = np.exp(e - e.max())
        return e / e.sum()

    def train(self, i, t, x, y, gt):
        self.batch[i] = x, y
        self.mix[i] = self.responsibilities(i, x, y)
        self.assigned[i] = int(self.mix[i].argmax())
        self.local[i] = [fit(m, x, y, self.o, rate=self.o.rate * r) for m, r in zip(self.bank, self.mix[i], strict=True)]

    def federate(self, t):
        w = self.weights()
        self.bank = [mean_of([self.local[i][c] for i in range(self.k)], [w[i] * self.mix[i, c] for i in range(self.k)]) for c in range(len(self.bank))]
        return self.traffic(2 * self.k * len(self.bank) * self.size)


class FedRc(FedEm):
    """Responsibilities also count the likeness of label shares."""

    def __init__(self, *a):
        super().__init__(*a)
        self.labels = np.full((len(self.bank), self.c), 1 / self.c)

    def responsibilities(self, i, x, y):
        own = np.bincount(y, minlength=self.c) / max(1, len(y))
        e = -np.array([loss(m, x, y) for m in self.bank]) + 0.5 * self.labels @ own + 0.1 * np.log(np.maximum(self.mix[i], 1e-12))
        e = np.exp(e - e.max())
        return e / e.sum()

    def federate(self, t):
        out = super().federate(t)
        shares = np.stack([np.bincount(y, minlength=self.c) / max(1, len(y)) for _, y in self.batch])
        self.labels = (self.mix.T @ shares) / np.maximum(self.mix.sum(0)[:, None], 1e-12)
        return out


class Cfl(Method):
    """Clusters split in two where their mean update is small but some update is large."""

    def __init__(self, *a):
        super().__init__(*a)
        self.update, self.rounds = np.zeros((self.k, self.size)), 0

    def train(self, i, t, x, y, gt):
        before = self.models[i]
        super().train(i, t, x, y, gt)
        self.update[i] = (self.models[i] - before).ravel()

    def federate(self, t):
        self.rounds += 1
        for c in sorted(set(self.assigned)):
            own = [i for i in range(self.k) if self.assigned[i] == c]
            sizes = np.linalg.norm(self.update[own], axis=1)
            small = np.linalg.norm(self.update[own].mean(0)) < self.o.get("small", 0.4)
            if len(own) > 2 and self.rounds > self.o.get("wait", 20) and small and sizes.max() > self.o.get("large", 1.6):
                half = solvers.linkage(self.cosine_distance(self.update[own]), "complete", clusters=2)
                fresh = max(self.assigned) + 1
                for i, h in zip(own, half, strict=True):
                    self.assigned[i] = fresh if h else c
        self.by_cluster(list(self.assigned))
        return self.round_trip()


class FedDrift(Method):
    """On drift a client takes its best stored model, or a new one if none is better than chance; similar ones merge."""

    def __init__(self, *a):
        super().__init__(*a)
        self.detectors = [Adwin() for _ in range(self.k)]
        self.stored: list[list[np.ndarray]] = [[m] for m in self.models]

    def train(self, i, t, x, y, gt):
        if any([self.detectors[i].update(float(e)) for e in self.predict(i, x) != y]):
            losses = [loss(m, x, y) for m in self.stored[i]]
            best = int(np.argmin(losses))
            if losses[best] >= math.log(self.c):
                self.stored[i].append(np.zeros_like(self.models[i]))
                best = len(self.stored[i]) - 1
            self.assigned[i], self.models[i] = best, self.stored[i][best]
        super().train(i, t, x, y, gt)
        self.stored[i][self.assigned[i]] = self.models[i]

    def federate(self, t):
        own = list(self.assigned)
        self.by_cluster(solvers.greedy_clusters(self.flat(), self.o.get("alike", 0.5)))
        self.assigned = own
        for i in range(self.k):
            self.stored[i][own[i]] = self.models[i]
        return self.round_trip()


class TrackedSummary(Method):
    """Clients are grouped by their running descriptions."""

    def __init__(self, *a):
        super().__init__(*a)
        self.seen: list[np.ndarray | None] = [None] * self.k

    def train(self, i, t, x, y, gt):
        super().train(i, t, x, y, gt)
        now = self.describe(i)
        self.seen[i] = now if self.seen[i] is None else 0.5 * self.seen[i] + 0.5 * now

    def federate(self, t):
        rows = np.stack(self.seen)
        self.by_cluster(solvers.greedy_clusters(rows, self.o.get("alike", 0.95)))
        return self.round_trip() + self.traffic(rows.size)


class Flux(Method):
    """Density clusters of standardised descriptions; k-means where there are none, or a stated number."""

    known: int | None = None

    def labels(self) -> np.ndarray:
        rows = np.stack([self.describe(i) for i in range(self.k)])
        rows = (rows - rows.mean(0)) / np.maximum(rows.std(0), 1e-9)
        if self.k < 3:
            return np.zeros(self.k, int)
        if self.known:
            return solvers.kmeans(rows, min(self.known, self.k), self.o.seed)
        far = np.sqrt(((rows[:, None] - rows) ** 2).sum(-1))
        near = np.where(np.eye(self.k, dtype=bool), np.inf, far).min(1)
        found = solvers.dbscan(far, max(0.25, 1.25 * float(np.median(near))))
        if (found >= 0).all() and len(set(found)) > 1:
            return found
        tried = [solvers.kmeans(rows, n, self.o.seed) for n in range(2, min(6, self.k - 1) + 1)]
        return max(tried, key=lambda own: solvers.silhouette(far, own)) if tried else np.zeros(self.k, int)

    def federate(self, t):
        self.by_cluster(self.labels())
        return self.round_trip() + self.traffic(self.k * (2 * self.d + self.c + self.c * self.d))


class FluxPrior(Flux):
    def __init__(self, *a):
        super().__init__(*a)
        self.known = self.o.clusters


class FedCcfa(Method):
    """Classifier rows are clustered label by label; a client's concept is its tuple of row clusters."""

    eps = 0.3

    def __init__(self, *a):
        super().__init__(*a)
        self.ids = [PersistentIds() for _ in range(self.c)]
        self.tuples: dict[tuple, int] = {}

    def row_labels(self, rows: np.ndarray) -> np.ndarray:
        far = self.cosine_distance(rows)
        # rows are compared by how differently they lie to all others
        gap = np.array([[np.abs(np.delete(far[i] - far[j], [i, j])).mean() if len(far) > 2 else 0.0 for j in range(len(far))] for i in range(len(far))])
        return solvers.dbscan(gap, self.eps)

    def federate(self, t):
        found = []
        for c in range(self.c):
            rows = np.stack([m[c] for m in self.models])
            own = self.row_labels(rows)
            own = np.where(own < 0, own.max() + 1 + np.arange(self.k), own)
            centres = {int(g): rows[own == g].mean(0) for g in set(own)}
            names = self.ids[c].match(centres)
            for i in range(self.k):
                self.models[i][c] = centres[int(own[i])]
            found.append([names[int(g)] for g in own])
        self.assigned = [self.tuples.setdefault(x, len(self.tuples)) for x in zip(*found, strict=True)]
        return self.round_trip() + self.traffic(self.k * self.c * self.d)


class FedCcfaRows(FedCcfa):
    eps = 0.1

    def row_labels(self, rows):
        return solvers.dbscan(self.cosine_distance(rows), self.eps)


class Hcfl(Method):
    def federate(self, t):
        self.by_cluster(solvers.linkage(self.cosine_distance(self.flat()), "average", threshold=self.o.get("cut", 0.5)))
        return self.round_trip()


class FedGwc(Method):
    """Gaussian kernel of the mean transport distance between models' rows, then density clusters."""

    def federate(self, t):
        far = np.array([[np.mean([solvers.wasserstein(a[c], b[c]) for c in range(self.c)]) for b in self.models] for a in self.models])
        scale = float(np.median(far[far > 0])) if (far > 0).any() else 1.0
        own = solvers.dbscan(1 - np.exp(-(far**2) / (2 * scale**2)), self.o.get("eps", 0.3))
        self.by_cluster(np.where(own < 0, own.max() + 1 + np.arange(self.k), own))
        return self.round_trip()


METHODS: dict[str, type[Method]] = {
    "LocalOnly": Method, "FedAvg": FedAvg, "Oracle": Oracle, "FedProx": FedProx,
    "SCAFFOLD": Scaffold, "Adaptive-FedAvg": AdaptiveFedAvg, "CompressedFedAvg": CompressedFedAvg, "Flash": Flash, "FedProto": FedProto, "Ditto": Ditto,
    "pFedMe": PFedMe, "APFL": Apfl, "ATP": Atp, "FedEM": FedEm, "IFCA": Ifca, "FeSEM": Ifca, "FedRC": FedRc, "CFL": Cfl, "FedDrift": FedDrift,
    "TrackedSummary": TrackedSummary, "FLUX": Flux, "FLUX-prior": FluxPrior, "FedCCFA": FedCcfa, "FedCCFA-Impl": FedCcfaRows, "HCFL": Hcfl, "FedGWC": FedGwc,
}


def simulate_run(batches: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], gt: np.ndarray, method: str, o: Options) -> list[tuple]:
    """(client, t, gt, pred, acc, bytes) of one run; bytes are the step's total, on client 0."""
    clients, steps = gt.shape
    d = next(iter(batches.values()))[0].shape[1]
    classes = max(2, max(int(y.max()) for _, y in batches.values() if len(y)) + 1)
    m = METHODS[method](clients, d, classes, o)
    out = []
    for t in range(steps):
        acc = []
        for i in range(clients):
            x, y = batches[i, t]
            half = len(y) // 2
            acc.append(float((m.predict(i, x[:half]) == y[:half]).mean()) if half else 0.0)
            m.train(i, t, x[half:], y[half:], int(gt[i, t]))
        sent = m.federate(t) if (t + 1) % o.every == 0 and t < steps - 1 else 0.0
        out += [(i, t, int(gt[i, t]), int(m.assigned[i]), acc[i], sent if i == 0 else 0.0) for i in range(clients)]
    return out


def simulate(settings: DataFrame) -> DataFrame:
    """Runs every row of (run, method, seed, K, T, n, rho, alpha, delta, kind, every[, config]).

    ``config``, where it is a column, holds further settings of the method as a JSON object."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in part.itertuples():
                c = GeneratorConfig(int(s.K), int(s.T), int(s.n), float(s.rho), float(s.alpha), float(s.delta), s.kind, int(s.seed))
                shared = markov(c.steps, c.concepts, np.random.default_rng([c.seed, 0]))
                gt = np.empty((c.clients, c.steps), int)
                for i in range(c.clients):
                    rng = np.random.default_rng([c.seed, 1, i])
                    own = markov(c.steps, c.concepts, rng)
                    use = rng.random(c.steps) < c.alpha if 0 < c.alpha < 1 else np.full(c.steps, c.alpha == 1)
                    gt[i] = np.where(use, own, shared)
                batches = {(i, t): draw(c.kind, int(gt[i, t]), c.n_samples, c.delta, [c.seed, 2, i, t], c.n_features) for i in range(c.clients) for t in range(c.steps)}
                rows = simulate_run(batches, gt, s.method, Options(every=int(s.every), seed=c.seed, clusters=c.concepts, extra=json.loads(getattr(s, "config", None) or "{}")))
                yield pd.DataFrame([(s.run, s.method, c.seed, *r) for r in rows], columns=[x.split()[0] for x in OUT.split(", ")])

    # settings are long-running and few: one task each
    return settings.repartition(F.col("run"), F.col("method"), F.col("seed")).mapInPandas(run, OUT)


def simulate_on(samples: DataFrame, grid: DataFrame, method: str, options: Options | None = None) -> DataFrame:
    """Runs a method on given samples (run, client, t, row_id, x, y) and grid (run, client, t, gt); one group a run."""
    o = options or Options()

    def run(part: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        columns = [x.split()[0] for x in OUT.split(", ")]
        if part.empty or cells.empty:
            return pd.DataFrame(columns=columns)
        clients = {c: i for i, c in enumerate(sorted(cells["client"].unique()))}
        steps = {t: i for i, t in enumerate(sorted(cells["t"].unique()))}
        gt = np.zeros((len(clients), len(steps)), int)
        gt[cells["client"].map(clients), cells["t"].map(steps)] = cells["gt"]
        d = len(part["x"].iloc[0])
        batches = {(i, t): (np.zeros((0, d)), np.zeros(0, int)) for i in clients.values() for t in steps.values()}
        for (c, t), rows in part.sort_values("row_id").groupby(["client", "t"]):
            if c in clients and t in steps:
                batches[clients[c], steps[t]] = np.stack(rows["x"]), rows["y"].to_numpy(int)
        back_c, back_t = list(clients), list(steps)
        rows = simulate_run(batches, gt, method, o)
        name = str(cells["run"].iloc[0])
        return pd.DataFrame([(name, method, o.seed, back_c[i], back_t[t], g, p, a, b) for i, t, g, p, a, b in rows], columns=columns)

    # fresh names for both sides, since grid and samples may come from one frame
    left = samples.select(*[F.col(c).alias(c) for c in ("run", "client", "t", "row_id", "x", "y")])
    right = grid.select(*[F.col(c).alias(c) for c in ("run", "client", "t", "gt")])
    return left.groupBy("run").cogroup(right.groupBy("run")).applyInPandas(run, OUT)
