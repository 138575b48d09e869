"""Stably expressed genes: a gamma-normal mixture for each gene, and ranks of its parameters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import zero_fraction
from .stats import anova_f, average_rank, minmax

#: The largest shape of the gamma part, the least number of points, the change below which a fit has settled.
MAX_SHAPE, LEAST_POINTS, SETTLED, ROUNDS = 150.0, 5, 1e-7, 10000


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def inverse_digamma(y: float) -> float:
    """Newton from Minka's start."""
    x = math.exp(y) + 0.5 if y >= -2.22 else -1 / (y + 0.5772156649015329)
    for _ in range(8):
        x = max(x - (digamma(x) - y) / trigamma(x), 1e-12)
    return x


def mixture(values: np.ndarray, counts: np.ndarray | None = None) -> dict | None:
    """EM of rho * normal(mu, sigma) + (1 - rho) * gamma(shape, rate) over positive values; None for too few.

    counts: how often each value is there (once). Starts from the upper half as the normal part (a value across the
    middle by its share), so that a fit is the same on every run, and the same from runs of values as from single ones.
    """
    counts = np.ones(len(values)) if counts is None else np.asarray(counts, float)
    order = np.argsort(values, kind="stable")
    order = order[values[order] > 0]
    x, c = values[order], counts[order]
    n = c.sum()
    if n < LEAST_POINTS:
        return None
    logs = np.log(x)
    part = np.clip(np.cumsum(c) - np.ceil(n / 2), 0, c) / c
    shape, old = 1.0, None
    for _ in range(ROUNDS):
        own, others = c * part, c * (1 - part)
        weight, rest = max(own.sum(), 1e-12), max(others.sum(), 1e-12)
        mu = float(own @ x / weight)
        var = max(float(own @ (x - mu) ** 2 / weight), 1e-11)
        rate = shape * rest / max(float(others @ x), 1e-12)
        mean_log = float(others @ logs) / rest
        shape = min(inverse_digamma(min(math.log(rate) + mean_log, 6.0)), MAX_SHAPE)
        rho = min(max(float(own.sum() / n), 1e-12), 1 - 1e-12)
        normal = math.log(rho) - 0.5 * math.log(2 * math.pi * var) - (x - mu) ** 2 / (2 * var)
        gamma = math.log(1 - rho) + shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * logs - rate * x
        part = 1 / (1 + np.exp(np.clip(gamma - normal, -700, 700)))
        new = (mu, var, shape, rate, rho)
        if old is not None and max(abs(a - b) for a, b in zip(new, old, strict=True)) <= SETTLED:
            break
        old = new
    loglik = float(c @ np.logaddexp(normal, gamma))
    hard = float(-2 * (c @ np.log(np.maximum(np.maximum(part, 1 - part), 1e-300))))
    return {"mu": mu, "sigma": math.sqrt(var), "shape": shape, "rate": rate, "rho": rho, "loglik": loglik, "aic": 2 * 5 - 2 * loglik, "bic": 5 * math.log(n) - 2 * loglik, "icl": 5 * math.log(n) - 2 * loglik + hard}


def parameters(expr: DataFrame) -> DataFrame:
    """(gene_id, mu, sigma, rho) of each gene's positive values; nulls where there are too few.

    Values go as runs with their counts, combined where they arise: a task has a gene's different values, not its cells.
    """
    kind = dict(expr.dtypes)["gene_id"]

    def rows(table: pa.Table) -> pa.Table:
        got = mixture(table["value"].to_numpy(), table["n"].to_numpy()) or {}
        return pa.table({"gene_id": table["gene_id"][:1], **{c: pa.array([got.get(c)], pa.float64()) for c in ("mu", "sigma", "rho")}})

    runs = expr.where("value > 0").groupBy("gene_id", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
    return runs.groupBy("gene_id").applyInArrow(rows, f"gene_id {kind}, mu double, sigma double, rho double")


def index(params: DataFrame, zeros: DataFrame, f_stats: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(gene_id, seg_idx, rho, sigma, mu, mu_scaled, zero[, f_stats]): the mean of rank scores."""
    df = minmax(params.join(zeros, "gene_id"), "mu", "mu_scaled").withColumn("zero", F.col("zero_fraction") * F.col("mu_scaled")).drop("zero_fraction")
    n = F.count("*").over(Window.partitionBy())
    score = lambda c: average_rank(F.round(c, digits)) / (n + 1)
    parts = [score("rho"), 1 - score("sigma"), 1 - score("zero")]
    if f_stats is not None:
        df = df.join(f_stats.withColumnRenamed("log2_f", "f_stats"), "gene_id")
        parts.append(1 - score("f_stats"))
    return df.withColumn("seg_idx", sum(parts[1:], parts[0]) / len(parts))


def stable_genes(expr: DataFrame, cells: DataFrame, by_type: bool = False, most_zero: float = 0.8, least_genes: int = 100, return_all: bool = False) -> DataFrame:
    zeros = zero_fraction(expr, cells)
    kept = zeros.where(F.round("zero_fraction", 9) <= most_zero)
    n, all_ = kept.count(), zeros.count()
    if n < least_genes and n < all_:
        raise ValueError(f"{n} genes are left, fewer than {least_genes}")
    held = expr.join(kept.select("gene_id"), "gene_id", "left_semi")
    out = index(parameters(held), kept, anova_f(held, cells) if by_type else None)
    return expr.select("gene_id").distinct().join(out, "gene_id", "left") if return_all else out

