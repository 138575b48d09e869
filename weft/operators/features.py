"""Variable genes, and which genes clustering and matching look at."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import expressed
from .linear import matrix, sum_arrays


def top_variable(expr: DataFrame, cells: DataFrame, n: int = 2000) -> DataFrame:
    """The n genes of largest mean within-batch variance (zeros counted), ties by name: (gene_id, variance)."""
    size = cells.groupBy("batch").agg(F.count("*").alias("n"))
    sums = expr.join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(size, "batch")
    var = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return sums.groupBy("gene_id").agg(F.round(F.sum(var) / F.lit(1.0), 6).alias("variance")).orderBy(F.desc("variance"), "gene_id").limit(n)


def chi2_tail(x: float, k: float) -> float:
    """P(chi-square with k degrees > x): the series of the lower part, or the continued fraction of the upper one."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 1.0
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = 1
        while term > total * 1e-17:
            term *= h / (a + n)
            total += term
            n += 1
        return 1 - front * total
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        step = i * (a - i)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def _beyond_trend(n: int, s: np.ndarray, ss: np.ndarray, fdr: float, least_dispersion: float) -> np.ndarray:
    """Mask of genes more variable than the technical trend cv2 = a1 / mean + a0, by a chi-square test at a false discovery rate."""
    mean, var = s / n, (ss - s * s / n) / max(n - 1, 1)
    fine = (mean > 0) & (var > 0)
    out = np.zeros(len(s), bool)
    if n < 3 or fine.sum() < 3:
        return out
    cv2 = var[fine] / mean[fine] ** 2
    d = np.stack([np.ones(fine.sum()), 1 / mean[fine]], 1)
    a0, a1, w = 0.0, 1.0, np.ones(fine.sum())
    for _ in range(50):  # gamma regression with identity link
        a0, a1 = np.linalg.lstsq(d * w[:, None], cv2 * w, rcond=None)[0]
        w = 1 / np.maximum(d @ [a0, a1], 1e-8)
    expect = a1 * mean + max(a0, 0) * mean**2 + (least_dispersion * mean) ** 2 / (1 + 1 / n)
    p = np.array([chi2_tail(v * (n - 1) / e, n - 1) if f and e > 0 else 1.0 for v, e, f in zip(var, expect, fine, strict=True)])
    order = np.argsort(p, kind="stable")
    passed = p[order] <= fdr * np.arange(1, len(p) + 1) / len(p)
    out[order[: passed.nonzero()[0].max() + 1] if passed.any() else []] = True
    return out


def variable_genes(expr: DataFrame, cells: DataFrame, most_zero: float = 0.9, fdr: float = 0.01, least_dispersion: float = 0.5, at_least: int = 1) -> list[str]:
    """Genes more variable than the technical trend of their batch, in at_least batches.

    Gene statistics are aggregates; only they (genes by batches) reach the driver, where the trend is fitted.
    """
    size = {r["batch"]: r["n"] for r in cells.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    kept = expressed(expr, cells, most_zero, "batch")
    sums = expr.join(cells.select("cell_id", "batch"), "cell_id").groupBy("batch", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(kept, ["batch", "gene_id"], "left_semi")
    by: dict = {}
    for r in sums.collect():
        by.setdefault(r["batch"], []).append((r["gene_id"], r["s"], r["ss"]))
    seen: dict = {}
    for batch, rows in by.items():
        rows.sort()
        for i in np.flatnonzero(_beyond_trend(size[batch], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), fdr, least_dispersion)):
            seen[rows[i][0]] = seen.get(rows[i][0], 0) + 1
    return sorted(g for g, c in seen.items() if c >= at_least)


def block_moments(blocks: DataFrame) -> dict:
    """batch -> (cells, sums, sums of squares, cells that are not zero) of the genes, in one pass."""
    rows = sum_arrays(blocks.select("batch", "values"), "batch", prep=lambda x: np.hstack([x, x * x, x != 0])).toArrow()
    return {b: (n, *np.split(v, 3)) for b, n, v in zip(rows["batch"].to_pylist(), rows["n"].to_pylist(), matrix(rows["values"]), strict=True)}


def variable_positions(blocks: DataFrame, most_zero: float = 0.9, fdr: float = 0.01, least_dispersion: float = 0.5, at_least: int = 1) -> list[int]:
    """As variable_genes, of blocks(batch, values): positions in the arrays."""
    seen: np.ndarray | int = 0
    for n, s, ss, held in block_moments(blocks).values():
        fine = np.round(1 - held / n, 9) <= most_zero
        hit = np.zeros(len(s), bool)
        hit[fine] = _beyond_trend(n, s[fine], ss[fine], fdr, least_dispersion)
        seen = seen + hit
    return np.flatnonzero(seen >= at_least).tolist()


def smoothed(x: np.ndarray, y: np.ndarray, span: float = 0.3, bins: int = 200) -> np.ndarray:
    """A local linear trend of y over x (tricube weights), at medians of quantile bins of x, read off between them.

    Bins hold 20 values at least, so that a few outliers among them don't bend the trend.
    """
    order = np.argsort(x, kind="stable")
    parts = np.array_split(order, max(1, min(bins, len(order) // 20)))
    cx, cy, cw = (np.array(v) for v in zip(*((x[p].mean(), np.median(y[p]), len(p)) for p in parts), strict=True))
    k = min(len(cx), max(4, math.ceil(span * len(cx))))
    fit = np.empty(len(cx))
    for i, at in enumerate(cx):
        far = np.abs(cx - at)
        reach = max(np.partition(far, k - 1)[k - 1], 1e-300) * 1.000001
        w = cw * np.clip(1 - (far / reach) ** 3, 0, None) ** 3
        d = np.stack([np.ones(len(cx)), cx - at], 1)
        fit[i] = np.linalg.lstsq(d * np.sqrt(w)[:, None], cy * np.sqrt(w), rcond=None)[0][0]
    return np.interp(x, cx, fit)


def top_by_trend(blocks: DataFrame, n: int = 2000) -> list[int]:
    """Positions of the n genes whose variance exceeds the mean-variance trend most, on average over batches; only those that do."""
    parts = []
    for cells, s, ss, _ in block_moments(blocks).values():
        if cells > 2:
            mean, var = s / cells, np.maximum((ss - s * s / cells) / (cells - 1), 0)
            parts.append(var - np.maximum(smoothed(mean, var), 0))
    if not parts:
        raise ValueError("no batch has enough cells to find variable genes")
    excess = np.round(np.mean(parts, 0), 9)
    return sorted(i for i in np.argsort(-excess, kind="stable")[:n].tolist() if excess[i] > 0)


def union_of(marker_list: dict | list) -> list[int]:
    """Genes of all lists, in order of first appearance."""
    each = marker_list.values() if isinstance(marker_list, dict) else marker_list
    return list(dict.fromkeys(g for genes in each for g in genes))


def choose_genes(blocks: DataFrame, marker: list[int] | None = None, marker_list: dict | list | None = None) -> list[int]:
    """Positions that clustering and matching look at: the markers, or the union of lists by batch, or variable genes."""
    if marker is not None:
        return list(marker)
    if marker_list is not None:
        return union_of(marker_list)
    found = variable_positions(blocks)
    if not found:
        raise ValueError("no variable gene was found; name markers")
    return found
