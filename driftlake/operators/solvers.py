"""Small dense solvers in NumPy, for use inside grouped Arrow or pandas functions.

Their inputs are bounded by numbers of concepts, clusters or slots, never of rows.
"""

from __future__ import annotations

import math

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest matching (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        rows = assignment(cost.T)
        out = np.full(n, -1)
        out[rows] = np.arange(m)
        return out
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        best = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, bool)
        row, last = i, -1
        lengths = 0.0
        while True:
            reach = lengths + cost[row] - price_row[row] - price_col
            closer = ~done & (reach < best)
            best[closer], via[closer] = reach[closer], last
            open_ = np.where(done, np.inf, best)
            last = int(open_.argmin())
            lengths = open_[last]
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        price_row[i] += lengths
        for j in np.flatnonzero(done):
            if j != last and owner[j] >= 0:
                price_row[owner[j]] += lengths - best[j]
        price_col[done] -= lengths - best[done]
        while via[last] >= 0:
            owner[last] = owner[via[last]]
            last = via[last]
        owner[last] = i
    out = np.full(n, -1)
    held = np.flatnonzero(owner >= 0)
    out[owner[held]] = held
    return out


def best_mapping(counts: np.ndarray) -> np.ndarray:
    """For each row the column that a best matching gives it; -1 for rows left over."""
    return assignment(-counts.astype(float)) if counts.size else np.full(len(counts), -1)


def greedy_mapping(counts: np.ndarray) -> np.ndarray:
    """Takes the largest cell again and again, the first in row-major order among equals."""
    left = counts.astype(float).copy()
    out = np.full(len(counts), -1)
    for _ in range(min(counts.shape)):
        i, j = divmod(int(left.argmax()), counts.shape[1])
        if left[i, j] <= 0:
            break
        out[i] = j
        left[i], left[:, j] = -1, -1
    return out


def sinkhorn(cost: np.ndarray, a: np.ndarray, b: np.ndarray, reg: float = 0.1, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Entropic transport plan between masses a and b, in the log domain."""
    a, b = a / a.sum(), b / b.sum()
    with np.errstate(divide="ignore"):
        log_a, log_b = np.log(a), np.log(b)
    kernel = -cost / reg
    f, g = np.zeros(len(a)), np.zeros(len(b))

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(rounds):
        f = log_a - soft(kernel + g, 1)
        new = log_b - soft(kernel + f[:, None], 0)
        moved = np.nanmax(np.abs(np.where(np.isfinite(new), new - g, 0)))
        g = new
        if moved < tol:
            break
    return np.exp(kernel + f[:, None] + g)


def transport_similarity(cost: np.ndarray, a: np.ndarray, b: np.ndarray, tau: float = 1.0, **options) -> float:
    return float(math.exp(-(sinkhorn(cost, a, b, **options) * cost).sum() / tau))


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, starts: int = 5) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    best, labels = np.inf, np.zeros(len(x), int)
    rng = np.random.default_rng(seed)
    for _ in range(starts):
        centre = x[[int(rng.integers(len(x)))]]
        while len(centre) < k:
            far = ((x[:, None] - centre) ** 2).sum(-1).min(1)
            p = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
            centre = np.vstack([centre, x[rng.choice(len(x), p=p)]])
        own = None
        for _ in range(rounds):
            new = ((x[:, None] - centre) ** 2).sum(-1).argmin(1)
            if own is not None and (new == own).all():
                break
            own = new
            centre = np.stack([x[own == j].mean(0) if (own == j).any() else centre[j] for j in range(k)])
        spread = ((x - centre[own]) ** 2).sum()
        if spread < best - 1e-12:
            best, labels = spread, own
    return labels


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    kinds = np.unique(labels)
    if len(kinds) < 2 or len(kinds) >= len(labels):
        return -1.0
    mean = np.stack([distance[:, labels == c].sum(1) for c in kinds], 1)
    size = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    inside = mean[at, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[at, own] = np.inf
    near = other.min(1)
    top = np.maximum(inside, near)
    score = np.where((size[own] > 1) & (top > 0), (near - inside) / np.where(top > 0, top, 1), 0)
    return float(score.mean())


def dbscan(distance: np.ndarray, eps: float, least: int = 2) -> np.ndarray:
    """Labels by density; -1 is noise."""
    near = distance <= eps
    core = near.sum(1) >= least
    labels = np.full(len(distance), -1)
    label = 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        front = [i]
        labels[i] = label
        while front:
            j = front.pop()
            if core[j]:
                for q in np.flatnonzero(near[j] & (labels < 0)):
                    labels[q] = label
                    front.append(q)
        label += 1
    return labels


def linkage(distance: np.ndarray, how: str = "average", clusters: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Agglomerative labels, stopped at a number of clusters or above a distance."""
    groups = [[i] for i in range(len(distance))]
    merge = {"average": np.mean, "complete": np.max, "single": np.min}[how]
    while len(groups) > (clusters or 1):
        best, pair = np.inf, None
        for i in range(len(groups)):
            for j in range(i):
                d = merge(distance[np.ix_(groups[i], groups[j])])
                if d < best:
                    best, pair = d, (j, i)
        if pair is None or (threshold is not None and best > threshold):
            break
        groups[pair[0]] += groups.pop(pair[1])
    labels = np.empty(len(distance), int)
    for c, members in enumerate(sorted(groups, key=min)):
        labels[members] = c
    return labels


def max_gap_cut(distance: np.ndarray) -> np.ndarray:
    """Average linkage, cut in the middle of the largest gap between merge heights."""
    n = len(distance)
    heights = sorted(_merge_heights(distance))
    if n < 2:
        return np.zeros(n, int)
    gaps = np.diff(heights)
    if not len(gaps) or gaps.max() <= 0:
        return np.zeros(n, int)
    at = int(gaps.argmax())
    return linkage(distance, "average", threshold=(heights[at] + heights[at + 1]) / 2)


def _merge_heights(distance: np.ndarray) -> list[float]:
    groups, out = [[i] for i in range(len(distance))], []
    while len(groups) > 1:
        best, pair = min((distance[np.ix_(groups[i], groups[j])].mean(), (j, i)) for i in range(len(groups)) for j in range(i))
        out.append(float(best))
        groups[pair[0]] += groups.pop(pair[1])
    return out


def greedy_clusters(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """In order, each vector joins the cluster to whose members it is most similar on average (cosine), if by the threshold, or begins its own.

    The mean cosine to a cluster is that of the unit vectors' sum, so members aren't compared one by one."""
    size = np.linalg.norm(vectors, axis=1)
    unit = np.where(size[:, None] > 1e-12, vectors / np.maximum(size, 1e-12)[:, None], 0.0)
    sums, counts, labels = np.zeros((0, vectors.shape[1])), np.zeros(0), np.empty(len(vectors), int)
    for i, v in enumerate(unit):
        sims = sums @ v / counts
        j = int(np.argmax(sims)) if len(sims) else -1
        if j < 0 or sims[j] < threshold:
            j, sums, counts = len(counts), np.vstack([sums, np.zeros_like(v)]), np.append(counts, 0.0)
        sums[j] += v
        counts[j] += 1
        labels[i] = j
    return labels


def cosine(a: np.ndarray, b: np.ndarray, guard: float = 1e-12) -> float:
    norm = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / norm if norm > guard else 0.0


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """1-D transport distance between two samples of any sizes."""
    at = np.sort(np.concatenate([a, b]))
    width = np.diff(at)
    fa = np.searchsorted(np.sort(a), at[:-1], side="right") / len(a)
    fb = np.searchsorted(np.sort(b), at[:-1], side="right") / len(b)
    return float((np.abs(fa - fb) * width).sum())


def bandwidth(square: np.ndarray, how: str = "local", neighbours: int = 4) -> float:
    """A kernel width from squared distances between rows."""
    off = square[~np.eye(len(square), dtype=bool)]
    if not len(off):
        return 1.0
    if how == "local":
        rows = np.sort(np.where(np.eye(len(square), dtype=bool), np.inf, square), 1)[:, : min(neighbours, len(square) - 1)]
        return float(rows.mean()) + 1e-10
    return float({"p25": np.percentile(off, 25), "median": np.median(off), "mean": off.mean()}[how]) + 1e-10


def eigengap(values: np.ndarray, most: int, least: int = 1) -> int:
    """Number of clusters from ascending Laplacian eigenvalues: up to the last gap, the first left aside, that
    stands out from the noise of the plateau; without one, how many eigenvalues lie well below 1."""
    n = len(values)
    seen = min(most + 3, n)
    if seen < 2:
        return max(least, 1)
    # Five times the median gap of the plateau (1e-3 where there is none), 0.02 at least; 0.95
    plateau = max(most + 1, min(seen - 1, int(0.6 * n)))
    noise = float(np.median(np.abs(np.diff(values[plateau:])))) + 1e-6 if plateau < n - 1 else 1e-3
    gaps = np.diff(values[:seen])
    large = np.flatnonzero(gaps[1:] >= max(5 * noise, 0.02))
    found = int(large[-1]) + 2 if len(large) else max(1, int((values[:seen] < 0.95).sum()))
    return max(least, min(found, most))


def spectral(x: np.ndarray, most: int = 10, clusters: int | None = None, how: str = "local", seed: int = 42) -> np.ndarray:
    """Spectral clustering of few rows; the number of clusters from the eigengap if not given."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    square = ((x[:, None] - x) ** 2).sum(-1)
    near = np.exp(-square / (2 * bandwidth(square, how)))
    np.fill_diagonal(near, 0)
    scale = 1 / np.sqrt(np.maximum(near.sum(1), 1e-12))
    values, vectors = np.linalg.eigh(np.eye(n) - scale[:, None] * near * scale)
    k = clusters or eigengap(values, min(most, n - 1))
    if k <= 1:
        return np.zeros(n, int)
    rows = vectors[:, :k]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return kmeans(rows, k, seed)


def wilcoxon_p(n: int, w: float, ties: float) -> float:
    """Two-sided p of the smaller signed-rank sum of n differences; exact for up to 25 without ties.

    ``ties`` is the sum of k^3 - k over groups of k equal sizes."""
    if not n:
        return 1.0
    if n <= 25 and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2))) if var > 0 else 1.0


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """(smaller rank sum, two-sided p) of paired differences."""
    d = d[d != 0]
    value, back, times = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[back]
    w = float(min(rank[d > 0].sum(), rank[d < 0].sum()))
    return w, wilcoxon_p(len(d), w, float((times**3 - times).sum()))


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    at = np.concatenate([a, b])
    fa = np.searchsorted(np.sort(a), at, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), at, side="right") / len(b)
    return float(np.abs(fa - fb).max())


def ks_p_value(distance: float, n: int, m: int) -> float:
    """The asymptotic two-sided p of a two-sample Kolmogorov-Smirnov distance."""
    scale = math.sqrt(n * m / (n + m))
    x = (scale + 0.12 + 0.11 / scale) * distance
    if x < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)))))
