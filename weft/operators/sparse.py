"""Sparse cells through the fit: rows with positions and values, never spread out.

A row is (cell_id, ..., pos array<int> ascending, val array<double>), the genes that it leaves out being 0. Centring and
scaling stay apart from the rows: the residuals about replicate means don't see the centre at all, so their Gram matrix is
that of the raw cells less that of the replicates' sums (rows of weight -1 / n), scaled on both sides; a cell's factors
are a sparse product less a constant. So the fit takes memory in proportion to the values that are there, and what is
kept of a merge is a few factors a cell; dense rows appear only where adjusted values are asked for, gene by gene if
wanted.

Defined cases: a cell without values is all zero and is dropped by the merges; repeated positions in long rows add up;
values of 0 may be there or not, the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import linear
from .bulk import bulk_factors, sample_column
from .linear import HELD, MAX_GENES, added, fields, lists, matrix
from .stats import codes, folds

#: Products of pairs of values that a task expands at once.
PAIRS = 2 << 20


def sparse_rows(expr: DataFrame, genes: DataFrame, *keep: str) -> DataFrame:
    """Long rows as (cell_id, keep, pos, val). genes(gene_id, pos int): the place of each gene that takes part."""
    named = expr.join(genes.select("gene_id", "pos"), "gene_id").groupBy("cell_id", *keep, "pos").agg(F.sum(F.col("value").cast("double")).alias("v")).where("v <> 0")
    return gathered(named, *keep)


def gathered(named: DataFrame, *keep: str) -> DataFrame:
    """named(cell_id, keep, pos, v), each position once, as (cell_id, keep, pos, val)."""
    got = named.groupBy("cell_id", *keep).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_at"))
    return got.select("cell_id", *keep, F.col("_at.pos").alias("pos"), F.col("_at.v").alias("val"))


def from_dense(blocks: DataFrame) -> DataFrame:
    """blocks(values) with pos and val instead."""
    at = F.filter(F.transform("values", lambda v, i: F.struct(i.cast("int").alias("pos"), v.alias("v"))), lambda x: x["v"] != 0)
    return blocks.withColumn("_at", at).select(*[c for c in blocks.columns if c != "values"], F.col("_at.pos").alias("pos"), F.col("_at.v").alias("val"))


@dataclass
class Csr:
    """Some rows: values, their positions, and where each row starts."""

    pos: np.ndarray
    val: np.ndarray
    start: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), self.size)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Rows by columns of q."""
        out, row = np.empty((len(self.start) - 1, q.shape[1])), self.row()
        for f in range(q.shape[1]):
            out[:, f] = np.bincount(row, self.val * q[self.pos, f], len(out))
        return out

    def back(self, u: np.ndarray, n: int) -> np.ndarray:
        """The transpose times u: genes by columns of u."""
        out, row = np.empty((n, u.shape[1])), self.row()
        for f in range(u.shape[1]):
            out[:, f] = np.bincount(self.pos, self.val * u[row, f], n)
        return out

    def add_gram(self, w: np.ndarray, total: np.ndarray) -> None:
        """Adds the upper triangle of the sum of w v v' to total, some rows at a time."""
        n, end = len(total), self.start[1:]
        pairs = np.r_[0, np.cumsum(self.size * (self.size + 1) // 2)]
        i = 0
        while i < len(w):
            j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + PAIRS, "right")) - 1)
            lo, hi = self.start[i], self.start[j]
            at = np.arange(lo, hi)
            times = np.repeat(end[i:j], self.size[i:j]) - at  # partners: itself and those after it in its row
            first = np.repeat(at, times)
            second = first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
            weight = np.repeat(w[i:j], self.size[i:j])[first - lo]
            np.add.at(total.reshape(-1), self.pos[first] * n + self.pos[second], weight * self.val[first] * self.val[second])
            i = j


def csr(rb: pa.RecordBatch, pos: str = "pos", val: str = "val") -> Csr:
    p, v = rb.column(pos), rb.column(val)
    start = p.offsets.to_numpy().astype(np.int64)
    return Csr(p.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy(zero_copy_only=False).astype(float), start - start[0])


def unit_rows(m: Csr) -> Csr:
    """Rows at length one (the floor of the dense form)."""
    length = np.sqrt(np.bincount(m.row(), m.val**2, len(m.start) - 1))
    return Csr(m.pos, m.val / np.maximum(length, 1e-8)[m.row()], m.start)


def means(rows: DataFrame, n: int, unit: bool = False) -> np.ndarray:
    """Gene means, zeros counted; see linear.total_arrays."""
    cells, total = 0, np.zeros(n)
    for r in sums(rows.select("pos", "val", (F.spark_partition_id() / linear.FAN_IN).cast("int").alias("_fan")), n, "_fan", unit=unit).toLocalIterator():
        cells, total = cells + r["n"], total + np.array(r["values"])
    return total / max(cells, 1)


def sums(rows: DataFrame, n: int, *keys: str, squares: bool = False, unit: bool = False) -> DataFrame:
    """(keys, n, values): rows counted, and their values (and squares, behind them) added up by key; a task holds HELD bytes at most."""
    width = n * (1 + squares)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], t) for i, t in enumerate(kinds)), pa.array([v[0] for v in held.values()], pa.int64()), lists(np.stack([v[1] for v in held.values()]))], [*keys, "n", "values"])
            held.clear()
            return made

        for rb in batches:
            if not rb.num_rows:
                continue
            kinds = [rb.schema.field(k).type for k in keys]
            m = csr(rb)
            m = unit_rows(m) if unit else m
            of: dict = {}
            code = np.array([of.setdefault(k, len(of)) for k in zip(*(rb.column(k).to_pylist() for k in keys), strict=True)])
            count, row = np.bincount(code), m.row()
            by = np.argsort(code[row], kind="stable")
            edge = np.searchsorted(code[row][by], np.arange(len(of) + 1))
            for key, c in of.items():
                at = by[edge[c] : edge[c + 1]]
                total = np.bincount(m.pos[at], m.val[at], n)
                total = np.r_[total, np.bincount(m.pos[at], m.val[at] ** 2, n)] if squares else total
                if key in held:
                    held[key][0] += int(count[c])
                    held[key][1] += total
                else:
                    held[key] = [int(count[c]), total]
                if len(held) * width * 8 > HELD:
                    yield out()
        if held:
            yield out()

    named = rows.select(*keys, "pos", "val")
    return added(named.mapInArrow(part, f"{fields(rows, *keys)}, n long, values array<double>"), *keys)


def scale(rows: DataFrame, n: int, batch: str) -> tuple[np.ndarray, np.ndarray]:
    """Gene means and pooled within-batch deviations, zeros counted; one pass."""
    got = sums(rows, n, batch, squares=True).toArrow()
    m, both = got["n"].to_numpy(), matrix(got["values"])
    s, ss = both[:, :n], both[:, n:]
    within = (ss - s * s / m[:, None]).sum(0) / max(m.sum() - len(m), 1)
    return s.sum(0) / m.sum(), np.sqrt(np.maximum(within, 0))


def signed(rows: DataFrame, replicate: str) -> DataFrame:
    """(pos, val, w): the cells of replicates of two and more with weight 1, and the replicates' sums with -1 / n.

    The sum of w v v' is the Gram matrix of the residuals; sums are as sparse as the cells that they hold.
    """
    held = linear.in_groups(rows.select(replicate, "pos", "val"), replicate)
    size = held.groupBy(replicate).agg(F.count("*").alias("n"))
    parts = held.select(replicate, F.explode(F.arrays_zip("pos", "val")).alias("x")).groupBy(replicate, F.col("x.pos").alias("pos")).agg(F.sum("x.val").alias("v"))
    total = parts.groupBy(replicate).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_at")).join(size, replicate)
    total = total.select(F.col("_at.pos").alias("pos"), F.col("_at.v").alias("val"), (-1.0 / F.col("n")).alias("w"))
    return materialize(held.select("pos", "val", F.lit(1.0).alias("w")).unionByName(total), "signed")


def _summed(rows: DataFrame, shape: tuple[int, int], add, m: int | None = None) -> np.ndarray:
    """Sum over tasks of what add(csr, weights, total) adds to a matrix; strips of it are what is exchanged."""
    step = max(1, (1 << 18) // max(shape[1], 1))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rb in batches:
            if rb.num_rows:
                total = np.zeros(shape) if total is None else total
                add(csr(rb), rb.column("w").to_numpy(), total)
        for i in range(0, shape[0] if total is not None else 0, step):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([1], pa.int64()), lists(total[i : i + step].reshape(1, -1))], ["i", "n", "values"])

    few = rows if m is None else rows.coalesce(max(m, rows.sparkSession.sparkContext.defaultParallelism))
    out = np.zeros(shape)
    for r in added(few.mapInArrow(part, "i int, n long, values array<double>"), "i").toLocalIterator():
        out[r["i"] : r["i"] + step] = np.array(r["values"]).reshape(-1, shape[1])
    return out


def gram(rows: DataFrame, n: int, m: int | None = None) -> np.ndarray:
    """Sum of w v v' over rows(pos, val, w)."""
    half = _summed(rows, (n, n), lambda x, w, total: x.add_gram(w, total), m)
    return half + np.triu(half, 1).T


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """The same matrix times q; it is not formed."""
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def add(x: Csr, w: np.ndarray, total: np.ndarray) -> None:
        total += x.back(x.times(sent.value) * w[:, None], len(total))

    return _summed(rows, q.shape, add)


def fit(rows: DataFrame, n: int, replicate: str, controls: np.ndarray, sd: np.ndarray | None = None, rank: int | None = None, svd_k: int | None = 50, solver: str = "exact") -> np.ndarray:
    """Factors by genes of the residuals of the scaled cells, largest first; see linear.fit."""
    if solver not in linear.SOLVERS:
        raise ValueError(f"solver is one of {linear.SOLVERS}")
    m, groups = rows.agg(F.count("*"), F.countDistinct(replicate)).first()
    if groups >= m:
        return np.zeros((0, n))
    most = linear.svd_rank(m, groups, int(controls.sum()), svd_k if solver == "exact" else None)
    most = min(most, rank) if rank else most
    held = signed(rows, replicate)
    by = np.ones(n) if sd is None else 1 / sd
    if solver == "exact" and n <= MAX_GENES:
        return linear.factors(gram(held, n, m // n) * by[:, None] * by, most)
    apply = lambda q: by[:, None] * gram_times(held, by[:, None] * q)
    value, vector = linear.leading(apply, n, most, True) if solver == "random" else linear.lanczos(apply, n, most, settled=linear.FIT_SETTLED)[:2]
    keep = value > 1e-16 * max(value[0], 1e-300)
    return np.sqrt(value[keep])[:, None] * vector[:, keep].T


@dataclass
class SparseMerged:
    """A merge of sparse rows: the rows, each one's factors, and what turns them into adjusted values.

    rows(cell_id, ..., pos, val, w array<double>): the adjusted values of a cell are val at pos (0 elsewhere) less
    w times effect (factors by genes).
    """

    rows: DataFrame
    effect: np.ndarray
    alpha: np.ndarray

    def blocks(self, keep: np.ndarray | None = None) -> DataFrame:
        """Adjusted values as dense rows; keep: a mask of the genes wanted."""
        n = self.effect.shape[1]
        keep = np.ones(n, bool) if keep is None else np.asarray(keep, bool)
        names = [c for c in self.rows.columns if c not in ("pos", "val", "w")]
        place, effect = np.cumsum(keep) - 1, self.effect[:, keep]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if rb.num_rows:
                    m = csr(rb)
                    out = -(matrix(rb.column("w")).reshape(rb.num_rows, -1) @ effect)
                    some = keep[m.pos]
                    out[m.row()[some], place[m.pos[some]]] += m.val[some]
                    yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), lists(out)], [*names, "values"])

        return self.rows.mapInArrow(rows, f"{fields(self.rows, *names)}, values array<double>")


def with_factors(rows: DataFrame, alpha: np.ndarray, controls: np.ndarray, k: int, mean: np.ndarray, sd: np.ndarray | None = None, unit: bool = False) -> DataFrame:
    """rows with w: the factors that a cell's (scaled, centred) control values have; a pass without a shuffle."""
    a = alpha[: min(k, len(alpha))]
    ac = a[:, controls]
    q = np.zeros((len(controls), len(a)))
    q[controls] = np.linalg.solve(ac @ ac.T, ac).T if len(a) else np.zeros((int(controls.sum()), 0))
    q = q if sd is None else q / sd[:, None]
    less = mean @ q

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                m = csr(rb)
                m = unit_rows(m) if unit else m
                kept = [pa.ListArray.from_arrays(pa.array(m.start, pa.int32()), pa.array(m.val)) if c == "val" else rb.column(c) for c in rb.schema.names]
                yield pa.RecordBatch.from_arrays([*kept, lists(m.times(q) - less) if len(a) else pa.array([[]] * rb.num_rows, pa.list_(pa.float64()))], [*rb.schema.names, "w"])

    return rows.mapInArrow(part, f"{fields(rows, *rows.columns)}, w array<double>")


def merge_sparse(rows: DataFrame, n: int, controls: np.ndarray, k: int = 20, replicate: str = "cell_type", batch: str = "batch", svd_k: int = 50, solver: str = "exact") -> SparseMerged:
    """linear.adjust_scaled for sparse rows and one k: standardise, fit, adjust, undo the scaling."""
    controls = np.asarray(controls, bool)
    if len(controls) != n or not controls.any():
        raise ValueError("controls is a mask of the genes, with some of them")
    rows = rows.where(F.exists("val", lambda x: x != 0))
    mean, sd = scale(rows, n, batch)
    sd = np.where(sd > 0, sd, 1.0)
    alpha = fit(rows, n, replicate, controls, sd, k, svd_k, solver)
    return SparseMerged(with_factors(rows, alpha, controls, k, mean, sd), alpha[:k] * sd, alpha)


def merge_bulk_sparse(rows: DataFrame, n: int, controls: np.ndarray, k: int = 20, cell_type: str = "cell_type", k_bulk: int = 30, cosine: bool = True, chosen: list[int] | None = None, solver: str = "exact", seed: int = 1) -> SparseMerged:
    """bulk.merge_bulk for sparse rows(cell_id, batch[, condition], cell_type, pos, val): only the pseudo-bulk rows are dense."""
    controls = np.asarray(controls, bool)
    if len(controls) != n or not controls.any():
        raise ValueError("controls is a mask of the genes, with some of them")
    rows = rows.where(F.exists("val", lambda x: x != 0))
    cells = codes(sample_column(rows.drop("pos", "val")), "sample", cell_type, "cluster")
    extra = ["condition"] if "condition" in cells.columns else []
    dealt = materialize(folds(cells.select("cell_id", "sample", "cluster", *extra), "sample", k_bulk, seed), "folds")
    total = sums(rows.select("cell_id", "pos", "val").join(dealt, "cell_id"), n, "sample", "cluster", "fold", *extra, unit=cosine)
    bulk = total.withColumn("values", F.transform("values", lambda x: x / F.col("n")))
    small = (lambda df: linear.transform(df, {"values": lambda y: y[:, np.asarray(chosen)]})) if chosen is not None else (lambda df: df)
    alpha, _ = bulk_factors(bulk, controls, k, small, solver)
    mean = means(rows, n, cosine)
    return SparseMerged(with_factors(rows, alpha, controls, k, mean, unit=cosine), alpha[:k], alpha)
