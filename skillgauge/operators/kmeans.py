"""Steps of k-means on blocks of vectors, as matrix products.

The same steps serve a node that is spread over many blocks, whose sums Spark adds up, and a node that fits one task.
Distances, means and scores are rounded, so that neither the order of additions nor the cut into blocks
shows in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# A fit has settled when its centroids' squared shifts add up to at most this share of the mean variance.
TOLERANCE = 1e-4
# Decimals that distances, centroids and silhouettes keep.
DIGITS = 9


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row to every centroid."""
    crossed = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
    return np.maximum(np.round(crossed, DIGITS), 0.0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the smaller number on ties."""
    return distances(x, centroids).argmin(1)


def cluster_sums(x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vector sum of each cluster."""
    member = np.zeros((k, len(x)))
    member[labels, np.arange(len(x))] = 1
    return np.bincount(labels, minlength=k), member @ x


def moved(centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroids at the mean of their rows, and the squared shift; one without rows stays where it was."""
    means = np.where(counts[:, None] > 0, np.round(sums / np.maximum(counts, 1)[:, None], DIGITS), centroids)
    return means, float(((means - centroids) ** 2).sum())


def tolerance(counts: float, sums: np.ndarray, squares: np.ndarray) -> float:
    """From the sums of a node's vectors and of their squares."""
    return float(np.round(TOLERANCE * np.maximum(squares / counts - (sums / counts) ** 2, 0).mean(), 12))


def race(shares: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Arrival times of rows that start at a rate of their distance; rows at distance 0 never arrive."""
    with np.errstate(divide="ignore"):
        return np.where(far > 0, -np.log(shares) / np.where(far > 0, far, 1), np.inf)


def first_in(order: np.ndarray, ids: np.ndarray) -> int:
    """The row with the smallest order, then id."""
    at = np.flatnonzero(order == order.min())
    return int(at[ids[at].argmin()])


def units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))[:, None]
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0.0)


def cosine_scores(unit: np.ndarray, labels: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Cosine silhouette of each row, from the counts and sums of all unit vectors of its node per cluster."""
    away = counts[None, :] - unit @ sums.T
    rows = np.arange(len(unit))
    own = np.where((unit * unit).sum(1) > 0, 0.0, 1.0)
    n = counts[labels]
    inner = (away[rows, labels] - own) / np.maximum(n - 1, 1)
    outer = away / np.maximum(counts, 1)[None, :]
    outer[:, counts == 0] = np.inf
    outer[rows, labels] = np.inf
    outer = outer.min(1)
    top = np.maximum(inner, outer)
    valid = (n > 1) & np.isfinite(outer) & (top != 0)
    return np.where(valid, (outer - inner) / np.where(valid, top, 1), 0.0)


def starts(x: np.ndarray, ids: np.ndarray, draws: np.ndarray, most: int) -> list[int]:
    """Rows drawn as k-means++ does: each further one in proportion to the distance to the nearest so far."""
    chosen = [first_in(draws[:, 0], ids)]
    far = distances(x, x[chosen]).min(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(first_in(race(draws[:, len(chosen)], far), ids))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return chosen


class Fit:
    """Centroids on their way to rest, step by step, over rows that may lie anywhere.

    A fit has settled when a step hardly shifts its centroids, or brings them back to where they were: between rows that
    are closer than the rounding, steps can go in a circle. Where they were is kept at every power of two.
    """

    def __init__(self, centroids: np.ndarray, enough: float) -> None:
        self.centroids, self.enough = centroids, enough
        self.before: np.ndarray | None = None
        self.steps, self.settled = 0, False

    def step(self, counts: np.ndarray, sums: np.ndarray) -> None:
        self.centroids, shift = moved(self.centroids, counts, sums)
        self.settled = shift <= self.enough or (self.before is not None and np.array_equal(self.centroids, self.before))
        self.steps += 1
        if self.steps & (self.steps - 1) == 0:
            self.before = self.centroids


def fit(x: np.ndarray, centroids: np.ndarray, enough: float, steps: int | None) -> np.ndarray:
    """Centroids after as many steps as it takes to settle; more than `steps`, if given, are an error."""
    found = Fit(centroids, enough)
    while not found.settled:
        if found.steps == steps:
            raise RuntimeError(f"a k-means fit has not settled after {steps} steps")
        found.step(*cluster_sums(x, nearest(x, found.centroids), len(centroids)))
    return found.centroids


def split(x: np.ndarray, ids: np.ndarray, draws: np.ndarray, max_children: int, steps: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels and centroids of the count with the best silhouette; none if the node stays whole."""
    if len(x) <= 2:
        return None
    enough = tolerance(len(x), x.sum(0), (x * x).sum(0))
    first = starts(x, ids, draws, min(max_children, len(x) - 1))
    unit = units(x)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for k in range(2, min(len(x) - 1, max_children) + 1):
        centroids = fit(x, x[first[:k]], enough, steps)
        labels = nearest(x, centroids)
        counts, sums = cluster_sums(unit, labels, len(centroids))
        if (counts > 0).sum() < 2:
            return None
        score = round(float(cosine_scores(unit, labels, counts, sums).mean()), DIGITS)
        if score > 0 and (best is None or score > best[0]):
            best = score, labels, centroids
    return best and best[1:]


def subtree(x: np.ndarray, ids: np.ndarray, draws: np.ndarray, path: list[int], max_children: int, steps: int | None) -> Iterator[tuple[list[int], np.ndarray | None, list[int], np.ndarray | None]]:
    """(path, ids, None, None) of leaves and (path, None, clusters, centroids) of the nodes that are split."""
    todo = [(path, np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        found = split(x[rows], ids[rows], draws[rows], max_children, steps)
        if found is None:
            yield path, ids[rows], [], None
            continue
        labels, centroids = found
        there = np.unique(labels)
        yield path, None, there.tolist(), centroids[there]
        todo.extend(([*path, int(cluster)], rows[labels == cluster]) for cluster in there)
