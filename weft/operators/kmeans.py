"""k-means of every batch at once, many starts in one pass; no batch is gathered.

A pass sends the centres (batches by starts by centres) to the tasks; what comes back is a sum for each (batch, start,
centre), combined where it arises. Starts are seeded by oversampling: in each round every task keeps the points of least
exponential key, so that points far from the candidates so far are likely and a fixed number of them leaves a task; the
weighted candidates are then cut down to k on the driver. Random numbers come from cell ids, so reruns agree whatever
the partitions.

Defined cases: a batch with fewer different cells than centres has as many clusters as cells; a batch asked for one
centre is one cluster; ties go to the first centre and the first start; clusters are numbered from 1 by their least cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .linear import added, fields, lists, matrix

#: Seeding rounds, candidates in each for every centre, and Lloyd rounds at most.
SEED_ROUNDS, OVER, ROUNDS = 3, 2, 100
#: A start has settled when no centre moved further than this, against the spread of all.
SETTLED = 1e-9


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by starts) the nearest centre of each start and its squared distance; centres: starts by k by columns, nan where there is none."""
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    dist = (x**2).sum(1)[:, None] + (flat**2).sum(1) - 2 * x @ np.nan_to_num(flat).T
    dist = np.where(np.isnan(flat[:, 0]), np.inf, np.maximum(dist, 0)).reshape(len(x), starts, k)
    label = dist.argmin(2)
    return label, np.take_along_axis(dist, label[:, :, None], 2)[:, :, 0]


def _by_batch(rb: pa.RecordBatch, names) -> Iterator[tuple]:
    batch = np.array(rb.column("batch").to_pylist(), object)
    x = matrix(rb.column("values"))
    for b in dict.fromkeys(batch.tolist()):
        if b in names:
            at = np.flatnonzero(batch == b)
            yield b, at, x[at]


def survey(points: DataFrame, centres: dict) -> dict:
    """For each batch of centres: (sums, counts, errors) by start and centre; one pass."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for rb in batches:
            kind = rb.schema.field("batch").type
            for b, _, x in _by_batch(rb, sent.value):
                c = sent.value[b]
                starts, k, d = c.shape
                label, dist = nearest(x, c)
                place = (label + np.arange(starts) * k).ravel()
                count = np.bincount(place, minlength=starts * k).astype(float)
                sums = np.stack([np.bincount(place, np.repeat(x[:, j], starts), starts * k) for j in range(d)], 1)
                made = np.r_[sums.ravel(), count, dist.sum(0)]
                held[b] = held[b] + made if b in held else made
        for b, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], kind), pa.array([1], pa.int64()), lists(v.reshape(1, -1))], ["batch", "n", "values"])

    out = {}
    for r in added(points.select("batch", "values").mapInArrow(part, f"{fields(points, 'batch')}, n long, values array<double>"), "batch").toLocalIterator():
        starts, k, d = centres[r["batch"]].shape
        v = np.array(r["values"])
        out[r["batch"]] = v[: starts * k * d].reshape(starts, k, d), v[starts * k * d : starts * k * (d + 1)].reshape(starts, k), v[starts * k * (d + 1) :]
    return out


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes and a salt (the public splitmix64 finaliser; fixed values)."""
    u = np.uint64
    x = h + u((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return ((x ^ (x >> u(31))) >> u(11)).astype(float) / 2**53 + 2.0**-54


def _drawn(points: DataFrame, centres: dict | None, k: dict, starts: int, salt: int, many: int) -> dict:
    """{batch: [start] -> points}: many * k points of each start, likelier the further they are from the centres."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for rb in batches:
            kind = rb.schema.field("batch").type
            h = rb.column("h").to_numpy().view(np.uint64)
            for b, at, x in _by_batch(rb, k):
                far = nearest(x, sent.value[b])[1] if sent.value is not None else np.ones((len(x), starts))
                for s in range(starts):
                    with np.errstate(divide="ignore"):
                        key = np.where(far[:, s] > 0, -np.log(_uniform(h[at], salt * 1000 + s)) / far[:, s], np.inf)
                    some = np.flatnonzero(np.isfinite(key))
                    least = some[np.argsort(key[some], kind="stable")[: many * k[b]]]
                    old = held.get((b, s))
                    keys, rows = (key[least], x[least]) if old is None else (np.r_[old[0], key[least]], np.r_[old[1], x[least]])
                    pick = np.argsort(keys, kind="stable")[: many * k[b]]
                    held[b, s] = keys[pick], rows[pick]
        for (b, s), (keys, rows) in held.items():
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(keys), kind), pa.array([s] * len(keys), pa.int32()), pa.array(keys), lists(rows)], ["batch", "start", "key", "values"])

    found = points.select("batch", "values", "h").mapInArrow(part, f"{fields(points, 'batch')}, start int, key double, values array<double>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("batch", "start").orderBy("key", "values")))
    out: dict = {b: [[] for _ in range(starts)] for b in k}
    for r in best.where(f"r <= {many * max(k.values())}").orderBy("batch", "start", "r").toLocalIterator():
        if r["r"] <= many * k[r["batch"]]:
            out[r["batch"]][r["start"]].append(r["values"])
    return out


def _stacked(lists_of: list[list], d: int) -> np.ndarray:
    """Lists of points, one for each start, as starts by most by columns; nan where a start has fewer."""
    out = np.full((len(lists_of), max(1, *(len(x) for x in lists_of)), d), np.nan)
    for s, x in enumerate(lists_of):
        if len(x):
            out[s, : len(x)] = x
    return out


def _cut_down(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates: spread starts, then a few weighted rounds; nan if there are fewer different ones."""
    x, at = np.unique(x, axis=0, return_inverse=True)
    w = np.bincount(at.ravel(), w, len(x))
    x, w = x[w > 0], w[w > 0]
    out = np.full((k, x.shape[1]), np.nan)
    if len(x) <= k:
        out[: len(x)] = x
        return out
    c = x[[rng.choice(len(x), p=w / w.sum())]]
    while len(c) < k:
        d = ((x[:, None] - c) ** 2).sum(2).min(1) * w
        c = np.r_[c, x[[rng.choice(len(x), p=d / d.sum())]]]
    for _ in range(10):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([np.average(x[label == j], 0, w[label == j]) if (label == j).any() else c[j] for j in range(k)])
    out[:] = c
    return out


def seeds(points: DataFrame, k: dict, starts: int, seed: int = 1) -> dict:
    """{batch: starts by k by columns}."""
    first = _drawn(points, None, k, starts, seed * 100, 1)
    found = {b: [x[:1] for x in v] for b, v in first.items() if any(v)}
    if not found:
        return {}
    k = {b: k[b] for b in found}
    d = len(next(iter(found.values()))[0][0])
    for i in range(SEED_ROUNDS):
        more = _drawn(points, {b: _stacked(v, d) for b, v in found.items()}, k, starts, seed * 100 + i + 1, OVER)
        found = {b: [x + y for x, y in zip(v, more[b], strict=True)] for b, v in found.items()}
    stacked = {b: _stacked(v, d) for b, v in found.items()}
    counted = survey(points, stacked)
    rng = np.random.default_rng(seed)
    return {b: np.stack([_cut_down(c[s][~np.isnan(c[s][:, 0])], counted[b][1][s][~np.isnan(c[s][:, 0])], k[b], rng) for s in range(starts)]) for b, c in sorted(stacked.items(), key=lambda x: str(x[0]))}


def lloyd_rounds(points: DataFrame, centres: dict, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Centres after so many rounds (fewer if all starts have settled), and the error of each start before the last move."""
    centres = {b: c.copy() for b, c in centres.items()}
    error = {b: np.full(len(c), np.inf) for b, c in centres.items()}
    active = {b: np.arange(len(c)) for b, c in centres.items()}
    for _ in range(rounds):
        if not active:
            break
        got = survey(points, {b: centres[b][s] for b, s in active.items()})
        for b, (total, n, e) in got.items():
            at, old = active[b], centres[b][active[b]]
            new = np.where(n[:, :, None] > 0, total / np.maximum(n, 1)[:, :, None], old)
            error[b][at] = e
            centres[b][at] = new
            scale = max(float(np.nanmax(np.abs(new), initial=0)), 1e-300)
            moved = np.nanmax(np.abs(new - old), axis=(1, 2), initial=0) > SETTLED * scale
            active[b] = at[moved]
        active = {b: s for b, s in active.items() if len(s)}
    return centres, error


def assign(points: DataFrame, centres: dict) -> DataFrame:
    """(cell_id, batch, centre): the nearest of the batch's centres (k by columns), from 0."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            label = np.zeros(rb.num_rows, np.int32)
            for b, at, x in _by_batch(rb, sent.value):
                label[at] = nearest(x, sent.value[b][None])[0][:, 0]
            yield pa.RecordBatch.from_arrays([rb.column("cell_id"), rb.column("batch"), pa.array(label)], ["cell_id", "batch", "centre"])

    return points.select("cell_id", "batch", "values").mapInArrow(part, f"{fields(points, 'cell_id', 'batch')}, centre int")


def numbered(labels: DataFrame, label: str) -> DataFrame:
    """(cell_id, batch, cluster): labels of a batch numbered from 1 by their least cell."""
    first = labels.groupBy("batch", label).agg(F.min("cell_id").alias("first"))
    number = first.withColumn("cluster", F.row_number().over(Window.partitionBy("batch").orderBy("first")).cast("int"))
    return labels.join(number.select("batch", label, "cluster"), ["batch", label]).select("cell_id", "batch", "cluster")


def kmeans(points: DataFrame, k: dict, starts: int = 20, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(cell_id, batch, cluster): the start of least squared error of each batch. points(cell_id, batch, values)."""
    held = materialize(points.select("cell_id", "batch", "values", F.xxhash64("cell_id").alias("h")), "points")
    several = {b: n for b, n in k.items() if n > 1}
    centres, error = lloyd_rounds(held, seeds(held, several, starts, seed), rounds) if several else ({}, {})
    best = {b: c[int(np.argmin(np.round(error[b], 12)))] for b, c in centres.items()}
    return numbered(assign(held, best), "centre")
