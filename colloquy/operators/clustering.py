"""Clustering of one meeting's speaker vectors, in numpy inside the task that holds the meeting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum((x * x).sum(axis=1, keepdims=True), 1e-12))


def agglomerate(x: np.ndarray, threshold: float = 0.6) -> np.ndarray:
    """Centroid linkage: the nearest two clusters merge while they are no farther apart than ``threshold``.

    Clusters are numbered by their lowest row.
    """
    n = len(x)
    centre, size, owner = x.astype(float).copy(), np.ones(n), np.arange(n)
    d = ((centre[:, None] - centre[None]) ** 2).sum(axis=2) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        if d[i, j] > threshold**2:
            break
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        owner[owner == j] = i
        d[j], d[:, j] = np.inf, np.inf
        alive = np.isfinite(d[i])
        d[i, alive] = d[alive, i] = ((centre[alive] - centre[i]) ** 2).sum(axis=1)
    return np.unique(owner, return_inverse=True)[1]


@dataclass
class Mixture:
    responsibilities: np.ndarray
    priors: np.ndarray
    centroids: np.ndarray


def _log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.maximum(np.exp(x - top).sum(axis=1, keepdims=True), 1e-12))


def variational_bayes(features: np.ndarray, vectors: np.ndarray, phi: np.ndarray, labels: np.ndarray, fa: float = 0.07, fb: float = 0.8, rounds: int = 20, least_gain: float = 1e-4) -> Mixture:
    """Speakers by variational Bayes from first ``labels``; speakers with a prior of 1e-7 or less vanish."""
    if len(features) < 2:
        return Mixture(np.zeros((len(features), 1)), np.ones(1), vectors.mean(axis=0, keepdims=True))
    k = max(1, int(labels.max()) + 1)
    gamma = np.exp(7.0 * (np.eye(k)[np.clip(labels, 0, k - 1)] - 1))
    gamma /= gamma.sum(axis=1, keepdims=True)
    priors, rho = np.full(k, 1.0 / k), features * np.sqrt(np.maximum(phi, 1e-12))
    constant = -0.5 * ((features**2).sum(axis=1, keepdims=True) + features.shape[1] * np.log(2 * np.pi))
    before = None
    for _ in range(rounds):
        spread = 1.0 / (1.0 + fa / fb * gamma.sum(axis=0)[:, None] * phi)
        alpha = fa / fb * spread * (gamma.T @ rho)
        joint = fa * (rho @ alpha.T - 0.5 * ((spread + alpha**2) @ phi) + constant) + np.log(priors + 1e-8)
        marginal = _log_sum_exp(joint)
        gamma = np.exp(joint - marginal)
        priors = gamma.sum(axis=0)
        if priors.sum() > 1e-12:
            priors = priors / priors.sum()
        bound = marginal.sum() + fb * 0.5 * (np.log(np.maximum(spread, 1e-12)) - spread - alpha**2 + 1).sum()
        if before is not None and bound - before < least_gain:
            break
        before = bound
    kept = np.flatnonzero(priors > 1e-7)
    kept = kept if len(kept) else np.array([0])
    weights = gamma[:, kept]
    total = weights.sum(axis=0)[:, None]
    return Mixture(weights, priors[kept], weights.T @ vectors / np.where(total > 1e-12, total, 1.0))


def k_means(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Centres only: begun at row 0 and then the rows farthest from all centres; an empty cluster keeps its centre."""
    if len(x) <= k:
        return x.astype(float)
    centres = [x[0].astype(float)]
    for _ in range(k - 1):
        near = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(near))].astype(float))
    c, own = np.stack(centres), np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
        if (new == own).all():
            break
        own = new
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
    return c


def assign_best(scores: np.ndarray) -> np.ndarray:
    """The one-to-one assignment of rows to columns with the largest sum; -1 for rows left over."""
    rows, columns = scores.shape
    n = max(rows, columns)
    cost = np.zeros((n, n))
    cost[:rows, :columns] = scores.max(initial=0.0) - scores
    # padding is used as often in every assignment, so its cost does not matter
    # shortest augmenting paths with potentials
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        match[n], j = i, n
        least, way, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[j] != -1:
            used[j] = True
            r = match[j]
            free = ~used[:n]
            reduced = cost[r] - u[r] - v[:n]
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j = nxt
        while j != n:
            match[j], j = match[way[j]], way[j]
    out = np.full(rows, -1)
    for column in range(columns):
        if match[column] < rows:
            out[match[column]] = column
    return out


def assign_local(vectors: np.ndarray, energies: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A chunk's local speakers to global centroids by 1 + cosine; a silent one (energy 0.05 or less) counts -100."""
    scores = 1.0 + unit_rows(vectors) @ unit_rows(centroids).T
    scores[energies <= 0.05] = -100.0
    return assign_best(scores)


def number_of_speakers(found: int, wanted: int | None = None, least: int = 1, most: int = 8) -> int:
    """The wanted number, else the found one within its bounds; if it differs, k-means takes over."""
    return wanted if wanted else min(max(found, least), most)


@dataclass
class Plda:
    """Projection to a space where speakers spread by ``phi``."""

    mean1: np.ndarray
    mean2: np.ndarray
    lda: np.ndarray
    mu: np.ndarray
    transform: np.ndarray
    phi: np.ndarray

    @classmethod
    def read(cls, data: bytes, dim: int = 256, out: int = 128) -> Plda:
        """From a ``PLDA2.0`` file's bytes (little-endian, arrays in row order)."""
        if data[:8].rstrip(b"\0") != b"PLDA2.0":
            raise ValueError("not a PLDA2.0 file")
        at, parts = 8, []
        for kind, shape in (("<f8", (dim,)), ("<f4", (out,)), ("<f4", (dim, out)), ("<f8", (out,)), ("<f8", (out, out)), ("<f8", (out,))):
            n = int(np.prod(shape))
            parts.append(np.frombuffer(data, kind, n, at).reshape(shape).astype(float))
            at += n * int(kind[2])
        return cls(*parts)

    def project(self, x: np.ndarray) -> np.ndarray:
        a = unit_rows(x - self.mean1) * np.sqrt(len(self.mean1))
        b = unit_rows(a @ self.lda - self.mean2) * np.sqrt(len(self.mean2))
        return (b - self.mu) @ self.transform.T


def cluster_meetings(vectors: DataFrame, cluster: Callable[[np.ndarray], np.ndarray], key: str = "meeting_id", item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, item, cluster): ``cluster`` over each key's vectors in order of their items."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(item, kind="stable")
        return pd.DataFrame({key: g[key], item: g[item], "cluster": cluster(np.stack(g[vector]).astype(float)).astype("int32")})

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, item)}
    return vectors.select(key, item, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {item} {kinds[item]}, cluster int")


def speakers(x: np.ndarray, plda: Plda | None = None, wanted: int | None = None, threshold: float = 0.6) -> np.ndarray:
    """Labels of one meeting's vectors: centroid linkage, variational Bayes, k-means if another number is wanted."""
    normal = unit_rows(x)
    first = agglomerate(normal, threshold)
    features, phi = (plda.project(x), plda.phi) if plda else (normal, np.ones(x.shape[1]))
    centroids = variational_bayes(features, x, phi, first).centroids
    k = number_of_speakers(len(centroids), wanted)
    if k != len(centroids):
        centroids = k_means(normal, k)
    return np.argmax(normal @ unit_rows(centroids).T, axis=1)
