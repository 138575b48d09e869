"""Clusters within batches: k-means on principal directions, or communities of shared-neighbour graphs.

All batches go through the same passes and no batch is gathered in a task; see pca, kmeans, neighbours and communities.
lloyd() is for small matrices on the driver (marker means of replicates).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .communities import communities, shared_edges
from .kmeans import kmeans
from .neighbours import nearest_cells
from .pca import batch_scores

BACK_ENDS = ("exact", "approximate")


def lloyd(x: np.ndarray, k: int, starts: int = 20, rounds: int = 100, seed: int = 1) -> np.ndarray:
    """k-means labels 1..k of least squared error over several spread starts, numbered by first appearance."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    best, least = None, np.inf
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.r_[c, x[[rng.choice(len(x), p=d / d.sum())]]]
        label = None
        for _ in range(rounds):
            d = ((x[:, None] - c) ** 2).sum(2)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        error = d[np.arange(len(x)), label].sum()
        if error < least - 1e-12:
            best, least = label, error
    order = {old: i for i, old in enumerate(dict.fromkeys(best.tolist()), 1)}
    return np.array([order[v] for v in best.tolist()])


def cluster_batches(blocks: DataFrame, k: dict | None = None, neighbours_k: int = 10, starts: int = 20, seed: int = 1, neighbours: str = "exact") -> DataFrame:
    """(cell_id, batch, cluster): k-means on ten directions with k[batch] centres (1: one cluster), or, without k, shared-neighbour
    communities. neighbours: "exact" (all pairs of blocks), or "approximate" (a forest and an exchange between neighbours)."""
    if neighbours not in BACK_ENDS:
        raise ValueError(f"neighbours is one of {BACK_ENDS}")
    if k is not None:
        return kmeans(batch_scores(blocks), k, starts, seed)
    near = nearest_cells(blocks.select("cell_id", "batch", "values"), neighbours_k, neighbours, seed=seed)
    cells = blocks.select("cell_id", "batch")
    return communities(shared_edges(near, neighbours_k), cells)
