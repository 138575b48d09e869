"""Principal directions of each batch's scaled, centred columns, all batches in the same passes.

Partial Gram matrices are keyed by batch and strip of genes and added up as streams; a batch's matrix is decomposed in a
task of its own (genes squared, never cells). With more than MAX_GENES genes the batches' Lanczos searches go on side by
side, a pass for all of them. Loadings reach the tasks in lots of a bounded size.

Defined cases: columns that don't vary in a batch have no weight there; a batch with one cell, or without a column that
varies, has scores of 0; fewer columns than dims give as many directions, the others are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .linear import added, fields, lists, matrix

#: Bytes of loadings sent to the tasks at once, and of keyed partial sums that a task holds.
SENT, HELD = 64 << 20, 256 << 20


@dataclass
class Moments:
    """A batch's cells, column means, and 1 / deviation (0 where a column doesn't vary)."""

    n: int
    mean: np.ndarray
    by: np.ndarray


def batch_moments(blocks: DataFrame) -> dict:
    """Moments of each batch; one pass."""
    out = {}
    for r in linear.sum_arrays(blocks.select("batch", "values"), "batch", prep=lambda x: np.hstack([x, x * x])).toLocalIterator():
        s, ss = np.split(np.array(r["values"]), 2)
        mean = s / r["n"]
        var = np.maximum(ss - s * mean, 0) / max(r["n"] - 1, 1)
        some = var > 1e-12 * np.maximum(mean * mean, 1e-300)
        out[r["batch"]] = Moments(r["n"], mean, np.where(some, 1 / np.sqrt(np.where(some, var, 1)), 0.0))
    return out


def _keyed(blocks: DataFrame, shape: tuple[int, int], total, keys: list | None = None) -> DataFrame:
    """(batch, i, n, values): total(x, batch) added up by batch, in strips of rows from i on."""
    step = max(1, (1 << 17) // max(shape[1], 1))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, g in held.items():
                for i in range(0, shape[0], step):
                    yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([i], pa.int32()), pa.array([1], pa.int64()), lists(g[i : i + step].reshape(1, -1))], ["batch", "i", "n", "values"])
            held.clear()

        for rb in batches:
            if not rb.num_rows:
                continue
            kind = rb.schema.field("batch").type
            x, names = matrix(rb.column("values")), np.array(rb.column("batch").to_pylist(), object)
            for key in dict.fromkeys(names.tolist()):
                g = total(x[names == key], key)
                held[key] = held[key] + g if key in held else g
                if len(held) * g.nbytes > HELD:
                    yield from out()
        if held:
            yield from out()

    some = blocks if keys is None else blocks.where(F.col("batch").isin(keys))
    return added(some.select("batch", "values").mapInArrow(part, f"{fields(blocks, 'batch')}, i int, n long, values array<double>"), "batch", "i")


def batch_loadings(blocks: DataFrame, dims: int = 10, moments: dict | None = None) -> dict:
    """Columns by dims for each batch: the leading eigenvectors of its scaled columns' correlations, scaled themselves."""
    known = moments if moments is not None else batch_moments(blocks)
    if not known:
        return {}
    n = len(next(iter(known.values())).mean)
    if n <= linear.MAX_GENES:
        return _by_grams(blocks, dims, known, n)
    out: dict = {}
    for lot in _lots(list(known), n * (dims + 4) * 8 * 12):
        out |= _by_lanczos(blocks, dims, {b: known[b] for b in lot}, n)
    return out


def _lots(keys: list, size: int, limit: int = 512 << 20) -> Iterator[list]:
    per = max(1, limit // max(size, 1))
    for i in range(0, len(keys), per):
        yield keys[i : i + per]


def _by_grams(blocks: DataFrame, dims: int, known: dict, n: int) -> dict:
    kind = dict(blocks.dtypes)["batch"]
    grams = _keyed(blocks, (n, n), lambda x, _: x.T @ x)
    given = blocks.sparkSession.createDataFrame([(b, m.n, m.mean.tolist(), m.by.tolist()) for b, m in known.items()], f"batch {kind}, cells long, mean array<double>, by array<double>")

    def solve(strips: pa.Table, one: pa.Table) -> pa.Table:
        strips = strips.sort_by("i")
        g = np.concatenate([matrix(strips["values"].slice(r, 1)).ravel() for r in range(len(strips))]).reshape(n, n)
        cells, mean, by = one["cells"][0].as_py(), np.array(one["mean"][0].as_py()), np.array(one["by"][0].as_py())
        g = (g - cells * np.outer(mean, mean)) * np.outer(by, by)
        load = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1][:, :dims] * by[:, None]
        return pa.table({"batch": strips["batch"][:1], "load": lists(load.reshape(1, -1))})

    found = grams.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(solve, f"batch {kind}, load array<double>")
    return {r["batch"]: np.array(r["load"]).reshape(n, -1) for r in found.toLocalIterator()}


def _by_lanczos(blocks: DataFrame, dims: int, known: dict, n: int) -> dict:
    steps = {b: linear.lanczos_steps(n, min(dims, n)) for b in known}
    asked = {b: next(s) for b, s in steps.items()}
    out = {}
    while asked:
        sent = blocks.sparkSession.sparkContext.broadcast({b: q * known[b].by[:, None] for b, q in asked.items()})
        width = max(q.shape[1] for q in asked.values())

        def total(x: np.ndarray, b) -> np.ndarray:
            q = sent.value[b]  # noqa: B023
            made = np.zeros((n, width))  # noqa: B023
            made[:, : q.shape[1]] = x.T @ (x @ q)
            return made

        got = {b: np.zeros((n, width)) for b in asked}
        for r in _keyed(blocks, (n, width), total, list(asked)).toLocalIterator():
            v = np.array(r["values"]).reshape(-1, width)
            got[r["batch"]][r["i"] : r["i"] + len(v)] = v
        more = {}
        for b, q in asked.items():
            m = known[b]
            g = got[b][:, : q.shape[1]] - m.n * np.outer(m.mean, m.mean @ (q * m.by[:, None]))
            try:
                more[b] = steps[b].send(g * m.by[:, None])
            except StopIteration as end:
                out[b] = end.value[1] * m.by[:, None]
        asked = more
    return out


def batch_scores(blocks: DataFrame, dims: int = 10) -> DataFrame:
    """(cell_id, batch, values): each cell on its batch's leading directions."""
    known = batch_moments(blocks)
    load = batch_loadings(blocks, dims, known)
    named = blocks.select("cell_id", "batch", "values")
    out = None
    for lot in _lots(list(load), next(iter(load.values())).nbytes if load else 1, SENT):
        sent = blocks.sparkSession.sparkContext.broadcast({b: (load[b], known[b].mean @ load[b]) for b in lot})

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if rb.num_rows:
                    x, names = matrix(rb.column("values")), np.array(rb.column("batch").to_pylist(), object)
                    scores = np.zeros((len(x), dims))
                    for b in dict.fromkeys(names.tolist()):
                        by, less = sent.value[b]
                        at = names == b
                        scores[at, : by.shape[1]] = x[at] @ by - less
                    yield pa.RecordBatch.from_arrays([rb.column("cell_id"), rb.column("batch"), lists(scores)], ["cell_id", "batch", "values"])

        some = named.where(F.col("batch").isin(lot)).mapInArrow(rows, f"{fields(blocks, 'cell_id', 'batch')}, values array<double>")
        out = some if out is None else out.unionByName(some)
    return out if out is not None else named.withColumn("values", F.array_repeat(F.lit(0.0), dims))
