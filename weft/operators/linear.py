"""Removal of unwanted variation. Cells are rows with an array of genes; nothing of the size of the cells is collected.

The fit needs the leading directions of the residuals about replicate means. Cells that are a replicate of their own
leave no residual and take no part. With up to MAX_GENES genes the driver decomposes the gene-by-gene Gram matrix; with
more genes and up to MAX_CELLS cells the cell-by-cell one; beyond both, or with solver "lanczos", block Lanczos, and with
solver "random" a few rounds of subspace iteration, pass over the cells with a matrix of genes by factors. Partial sums are combined where they arise and added up by
streams sorted by key, so that a task holds one running sum of a key. The adjustment is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .pairs import block_cells, dealt

#: Genes, or cells, whose Gram matrix the driver decomposes: 4096 genes take 128 MB, 8192 cells 512 MB.
MAX_GENES, MAX_CELLS = 4096, 8192
SOLVERS = ("exact", "random", "lanczos")
#: Bytes of partial sums that a task holds before it sends them.
HELD = 64 << 20
#: Subspace iteration: directions beyond those asked for, passes of the random solver, and when the exact one has settled.
SPARE, PASSES, SETTLED, MOST_PASSES = 12, 4, 1e-9, 200
#: Residual of an eigenpair, against the largest value, at which Lanczos ends: values are right to about its square, vectors only to it
#: (over the gap to the next value). A fit, whose adjusted values depend on the vectors, goes on for longer.
LANCZOS_SETTLED, FIT_SETTLED = 1e-10, 1e-13
FLOATS = pa.list_(pa.float64())
Prep = Callable[[np.ndarray], np.ndarray]


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list array."""
    x = np.ascontiguousarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel())).cast(FLOATS)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def fields(df: DataFrame, *names: str) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kind[n]}" for n in names)


def arrays(expr: DataFrame, genes: list, *keep: str) -> DataFrame:
    """Long rows as (cell_id, keep, values): an array in the order of genes, zeros filled in."""
    spark = expr.sparkSession
    place = spark.createDataFrame(list(enumerate(genes)), f"pos int, {fields(expr, 'gene_id')}")
    got = expr.join(place, "gene_id").groupBy("cell_id", *keep).agg(F.collect_list("pos").alias("pos"), F.collect_list(F.col("value").cast("double")).alias("value"))
    n = len(genes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = np.zeros((rb.num_rows, n))
            pos, value = rb.column(rb.num_columns - 2), rb.column(rb.num_columns - 1)
            row = np.repeat(np.arange(rb.num_rows), np.diff(pos.offsets.to_numpy()))
            x[row, pos.flatten().to_numpy()] = value.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*rb.columns[:-2], lists(x)], [*rb.schema.names[:-2], "values"])

    return got.mapInArrow(rows, f"{fields(got, 'cell_id', *keep)}, values array<double>")


def long(blocks: DataFrame, *keep: str) -> DataFrame:
    return blocks.select("cell_id", *keep, F.posexplode("values").alias("gene_id", "value"))


def _added(keys: list[str]):
    """Rows sorted by their keys, with n and values added up by key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(now, kinds, strict=True)), pa.array([n], pa.int64()), lists(total[None])], [*keys, "n", "values"])

        for rb in batches:
            kinds = [rb.schema.field(k).type for k in keys]
            at, flat, counts = np.r_[0, np.cumsum(pc.list_value_length(rb.column("values")).to_numpy())], rb.column("values").flatten().to_numpy(), rb.column("n").to_pylist()
            for i, key in enumerate(zip(*(rb.column(k).to_pylist() for k in keys), strict=True)):
                x = flat[at[i] : at[i + 1]]  # keys may differ in length
                if key != now:
                    if now is not None:
                        yield out()
                    now, n, total = key, 0, np.zeros(len(x))
                n += counts[i]
                total += x
        if now is not None:
            yield out()

    return rows


def added(partial: DataFrame, *keys: str) -> DataFrame:
    """partial(keys, n, values) added up by key."""
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_added(list(keys)), f"{fields(partial, *keys)}, n long, values array<double>")


def sum_arrays(blocks: DataFrame, *keys: str, prep: Prep | None = None) -> DataFrame:
    """(keys, n, values): rows counted and their arrays (by way of prep) added up by key; without keys by a key of 0."""
    if not keys:
        blocks, keys = blocks.withColumn("_all", F.lit(0)), ("_all",)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kinds: list = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], t) for i, t in enumerate(kinds)), pa.array([v[0] for v in sums.values()], pa.int64()), lists(np.stack([v[1] for v in sums.values()]))], [*keys, "n", "values"])
            sums.clear()
            return made

        for rb in batches:
            if not rb.num_rows:
                continue
            kinds = [rb.schema.field(k).type for k in keys]
            x = matrix(rb.column("values"))
            x = prep(x) if prep else x
            of: dict = {}
            code = np.array([of.setdefault(k, len(of)) for k in zip(*(rb.column(k).to_pylist() for k in keys), strict=True)])
            o = np.argsort(code, kind="stable")
            total = np.add.reduceat(x[o], np.searchsorted(code[o], np.arange(len(of))), axis=0)
            for key, n, v in zip(of, np.bincount(code).tolist(), total, strict=True):
                if key in sums:
                    sums[key][0] += n
                    sums[key][1] += v
                else:
                    sums[key] = [n, v.copy()]
            if len(sums) * x.shape[1] * 8 > HELD:
                yield out()
        if sums:
            yield out()

    partial = blocks.select(*keys, "values").mapInArrow(rows, f"{fields(blocks, *keys)}, n long, values array<double>")
    return added(partial, *keys)


#: Partitions whose sums one task adds up before the driver adds these.
FAN_IN = 64


def total_arrays(blocks: DataFrame, prep: Prep | None = None) -> tuple[int, np.ndarray]:
    """Rows counted and their arrays added up: by FAN_IN partitions in tasks, then one sum after the other on the driver."""
    some = blocks.select("values", (F.spark_partition_id() / FAN_IN).cast("int").alias("_fan"))
    n, total = 0, None
    for r in sum_arrays(some, "_fan", prep=prep).toLocalIterator():
        x = np.array(r["values"])
        n, total = n + r["n"], x if total is None else total + x
    if total is None:
        raise ValueError("there are no cells")
    return n, total


def _products(blocks: DataFrame, weight: str | None, prep: Prep | None, total: Callable[[np.ndarray, np.ndarray], np.ndarray], m: int | None, step: int) -> np.ndarray:
    """Sum over rows of total(x, w), a matrix of genes by something: partial sums by task, in strips of genes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rb in batches:
            if rb.num_rows:
                x = matrix(rb.column(0))
                x = prep(x) if prep else x
                g = total(x, rb.column(1).to_numpy(zero_copy_only=False))
                held = g if held is None else held + g
        if held is not None:
            for i in range(0, len(held), step):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([1], pa.int64()), lists(held[i : i + step].reshape(1, -1))], ["i", "n", "values"])

    w = F.col(weight) if weight else F.lit(1.0)
    rows = blocks.select("values", w.cast("double").alias("w"))
    if m is not None:  # not more partial sums than pay
        rows = rows.coalesce(max(m, blocks.sparkSession.sparkContext.defaultParallelism))
    got = added(rows.mapInArrow(part, "i int, n long, values array<double>"), "i").toArrow().sort_by("i")
    return np.concatenate([matrix(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).ravel() for v in (got["values"].slice(r, 1).combine_chunks() for r in range(len(got)))]) if len(got) else np.zeros(0)


def gram(blocks: DataFrame, weight: str | None = None, prep: Prep | None = None, m: int | None = None) -> np.ndarray:
    """Sum of (weight) v v' over rows; genes squared reach the driver. m: how many rows there are, if known."""
    flat = _products(blocks, weight, prep, lambda x, w: (x * w[:, None]).T @ x, m, 64)
    n = int(round(len(flat) ** 0.5))
    return flat.reshape(n, n)


def times(blocks: DataFrame, q: np.ndarray, weight: str | None = None, prep: Prep | None = None) -> np.ndarray:
    """Gram matrix times q, without the Gram matrix."""
    sent = blocks.sparkSession.sparkContext.broadcast(q)
    flat = _products(blocks, weight, prep, lambda x, w: x.T @ ((x @ sent.value) * w[:, None]), None, 1024)
    return flat.reshape(-1, q.shape[1]) if len(flat) else np.zeros_like(q)


def group_sums(blocks: DataFrame, by: str, prep: Prep | None = None) -> DataFrame:
    """(by, n, values): sums of arrays, combined on the map side."""
    return sum_arrays(blocks, by, prep=prep)


def in_groups(blocks: DataFrame, replicate: str) -> DataFrame:
    """Cells whose replicate has another cell; the others are their own mean and leave no residual."""
    several = materialize(blocks.where(F.col(replicate).isNotNull()).groupBy(replicate).agg(F.count("*").alias("n")).where("n > 1").select(replicate), "replicates")
    return blocks.join(several, replicate, "left_semi").select(*blocks.columns)


def residual_gram(blocks: DataFrame, replicate: str, prep: Prep | None = None, m: int | None = None) -> np.ndarray:
    held = in_groups(blocks.select(replicate, "values"), replicate)
    sums = materialize(group_sums(held, replicate, prep).withColumn("w", 1 / F.col("n")), "group-sums")
    return gram(held, prep=prep, m=m) - gram(sums, "w")


def svd_rank(m: int, groups: int, controls: int, svd_k: int | None = 50) -> int:
    """How many factors there are: cells less replicate groups, controls, and svd_k where the solver is exact."""
    return max(0, min(x for x in (m - groups, controls, svd_k) if x is not None))


def fit(blocks: DataFrame, replicate: str, controls: np.ndarray, svd_k: int | None = 50, solver: str = "exact", rank: int | None = None, prep: Prep | None = None) -> np.ndarray:
    """Factors by genes, largest first; no rows if every cell is its own group. rank: how many are wanted at most."""
    if solver not in SOLVERS:
        raise ValueError(f"solver is one of {SOLVERS}")
    m, groups = blocks.agg(F.count("*"), F.countDistinct(replicate)).first()
    genes = len(controls)
    if groups >= m:
        return np.zeros((0, genes))
    most = svd_rank(m, groups, int(controls.sum()), svd_k if solver == "exact" else None)
    most = min(most, rank) if rank else most
    if solver == "exact" and genes <= MAX_GENES:
        return factors(residual_gram(blocks, replicate, prep, m // genes), most)
    if solver == "exact" and m <= MAX_CELLS:
        return cell_factors(blocks, replicate, most, prep)
    return by_passes(blocks, replicate, genes, most, solver == "random", prep)


def by_passes(blocks: DataFrame, replicate: str, genes: int, rank: int, quick: bool, prep: Prep | None = None) -> np.ndarray:
    """Leading factors of the residual Gram matrix, which is never formed: a few random passes, or Lanczos until it has settled."""
    held = materialize(in_groups(blocks.select(replicate, "values"), replicate), "in-groups")
    sums = materialize(group_sums(held, replicate, prep).withColumn("w", 1 / F.col("n")), "group-sums")
    apply = lambda q: times(held, q, prep=prep) - times(sums, q, "w")
    value, vector = leading(apply, genes, rank, True) if quick else lanczos(apply, genes, rank, settled=FIT_SETTLED)[:2]
    keep = value > 1e-16 * max(value[0], 1e-300)
    return np.sqrt(value[keep])[:, None] * vector[:, keep].T


def leading(apply: Callable[[np.ndarray], np.ndarray], n: int, rank: int, fixed: bool, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of a symmetric matrix that can only be applied: a few passes, or until they settle."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, rank + SPARE))))[0]
    last = None
    for _ in range(PASSES if fixed else MOST_PASSES):
        z = apply(q)
        t = q.T @ z
        value, turn = np.linalg.eigh((t + t.T) / 2)
        value, vector = value[::-1][:rank], (q @ turn[:, ::-1])[:, :rank]
        if not fixed and last is not None and np.abs(value - last).max() <= SETTLED * max(value[0], 1e-300):
            break
        last = value
        q = np.linalg.qr(z)[0]
    return value, vector


def lanczos_steps(n: int, rank: int, width: int | None = None, blocks: int = 10, seed: int = 1, settled: float = LANCZOS_SETTLED):
    """Generator that yields columns, is sent the Gram matrix times them, and returns what lanczos() does."""
    width = min(n, width or rank + 4)
    most = max(blocks * width, rank + 3 * width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    held, t, passes = np.zeros((n, 0)), np.zeros((0, 0)), 0
    while True:
        w = yield q
        passes += 1
        held = np.hstack([held, q])
        h = held.T @ w
        old = len(t)
        t = np.block([[t, h[:old]], [h[:old].T, (h[old:] + h[old:].T) / 2]])
        w = w - held @ h
        w -= held @ (held.T @ w)
        value, turn = np.linalg.eigh(t)
        value, turn = value[::-1], turn[:, ::-1]
        left = np.linalg.norm(w @ turn[old:, :rank], axis=0)
        room = n - held.shape[1]
        if room == 0 or left.max(initial=0) <= settled * max(value[0], 1e-300) or passes >= MOST_PASSES:
            return value[:rank], held @ turn[:, :rank], passes
        if held.shape[1] + width > most:
            keep = min(rank + width // 2, len(value))
            held, t = held @ turn[:, :keep], np.diag(value[:keep])
        q = np.linalg.qr(w)[0]
        q -= held @ (held.T @ q)
        q = np.linalg.qr(q)[0][:, : n - held.shape[1]]


def lanczos(apply: Callable[[np.ndarray], np.ndarray], n: int, rank: int, width: int | None = None, blocks: int = 10, seed: int = 1, settled: float = LANCZOS_SETTLED) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues and vectors of a Gram matrix that can only be applied, and the passes it took.

    One-sided block Lanczos bidiagonalisation: the projected matrix is B'B of the bidiagonal B, the long side (cells) is
    never kept, and the short side (genes by width columns a pass) is orthogonalised twice against all columns held. When
    `blocks` blocks are held the search restarts from the best Ritz vectors. Ends when the residuals of all wanted pairs
    are small against the largest value, or the columns span everything.
    """
    steps = lanczos_steps(n, rank, width, blocks, seed, settled)
    q = next(steps)
    while True:
        try:
            q = steps.send(apply(q))
        except StopIteration as end:
            return end.value


def cell_factors(blocks: DataFrame, replicate: str, rank: int, prep: Prep | None = None, strip: int = 4096) -> np.ndarray:
    """Leading factors by the cell-by-cell Gram matrix of the residuals, added up over strips of genes."""
    held = in_groups(blocks.select("cell_id", replicate, "values"), replicate)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = matrix(rb.column(2))
            x = prep(x) if prep else x
            for i in range(0, x.shape[1] if len(x) else 0, strip):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int32()), rb.column(0), rb.column(1), lists(x[:, i : i + strip])], ["i", "cell_id", "replicate", "values"])

    def residuals(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("cell_id")
        x = matrix(table["values"]).copy()
        of: dict = {}
        code = np.array([of.setdefault(r, len(of)) for r in table["replicate"].to_pylist()])
        o = np.argsort(code, kind="stable")
        mean = np.add.reduceat(x[o], np.searchsorted(code[o], np.arange(len(of))), axis=0) / np.bincount(code)[:, None]
        return table, x - mean[code]

    def products(table: pa.Table) -> pa.Table:
        _, x = residuals(table)
        return pa.table({"i": pa.array(np.arange(len(x)), pa.int32()), "n": pa.array(np.ones(len(x)), pa.int64()), "values": lists(x @ x.T)})

    strips = materialize(held.mapInArrow(cut, f"i int, {fields(blocks, 'cell_id')}, replicate {dict(blocks.dtypes)[replicate]}, values array<double>"), "strips")
    k = matrix(added(strips.groupBy("i").applyInArrow(products, "i int, n long, values array<double>"), "i").toArrow().sort_by("i")["values"])
    value, u = np.linalg.eigh((k + k.T) / 2)
    value, u = value[::-1][:rank], u[:, ::-1][:, :rank]
    u = u[:, value > 1e-16 * max(value[0], 1e-300)]
    sent = blocks.sparkSession.sparkContext.broadcast(u)

    def scores(table: pa.Table) -> pa.Table:
        table, x = residuals(table)
        return pa.table({"i": table["i"][:1], "values": lists((sent.value.T @ x).reshape(1, -1))})

    got = strips.groupBy("i").applyInArrow(scores, "i int, values array<double>").toArrow().sort_by("i")
    return np.concatenate([matrix(got["values"].slice(r, 1)).reshape(u.shape[1], -1) for r in range(len(got))], 1)


def factors(g: np.ndarray, rank: int) -> np.ndarray:
    value, vector = np.linalg.eigh((g + g.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    keep = [i for i in range(min(rank, len(value))) if value[i] > 1e-16 * max(value[0], 1e-300)]
    return np.sqrt(value[keep])[:, None] * vector[:, keep].T


def projector(alpha: np.ndarray, controls: np.ndarray, k: int) -> np.ndarray:
    """Controls by genes: what a cell's control values predict of its unwanted variation."""
    a = alpha[: min(k, len(alpha))]
    ac = a[:, controls]
    return ac.T @ np.linalg.solve(ac @ ac.T, a) if len(a) else np.zeros((int(controls.sum()), alpha.shape[1]))


def transform(blocks: DataFrame, made: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """blocks with a column for each of made, of their values: a pass without a shuffle, on streams as well."""
    names = [c for c in blocks.columns if c != "values" and c not in made]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                y = matrix(rb.column(rb.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *(lists(f(y)) for f in made.values())], [*names, *made])

    schema = ", ".join([fields(blocks, *names)] * bool(names) + [f"`{c}` array<double>" for c in made])
    return blocks.select(*names, "values").mapInArrow(rows, schema)


def adjusted(p: np.ndarray, controls: np.ndarray, mean: np.ndarray | None = None, keep: np.ndarray | None = None) -> Prep:
    """values less (controls' values, centred by mean) times p; keep: a mask of the genes that stay."""
    mean = np.zeros(len(controls)) if mean is None else mean
    p = p if keep is None else p[:, keep]
    return lambda y: (y if keep is None else y[:, keep]) - (y - mean)[:, controls] @ p


def adjust(blocks: DataFrame, p: np.ndarray, controls: np.ndarray, mean: np.ndarray | None = None, keep: np.ndarray | None = None) -> DataFrame:
    return transform(blocks, {"values": adjusted(p, controls, mean, keep)})


def regress_genes(blocks: DataFrame, eta: np.ndarray, controls: np.ndarray, intercept: bool = True) -> DataFrame:
    """Each cell's control values regressed on gene covariates eta (covariates by genes); what they predict is removed."""
    eta = np.atleast_2d(np.asarray(eta, float))
    if intercept and not (np.ptp(eta, 1) == 0).any():
        eta = np.vstack([np.ones(eta.shape[1]), eta])
    return adjust(blocks, projector(eta, controls, len(eta)), controls)


def means(blocks: DataFrame, prep: Prep | None = None) -> np.ndarray:
    n, total = total_arrays(blocks, prep)
    return total / n


def scale(blocks: DataFrame, batch: str) -> tuple[np.ndarray, np.ndarray]:
    """Gene means and pooled within-batch deviations, of one pass."""
    got = sum_arrays(blocks.select(batch, "values"), batch, prep=lambda x: np.hstack([x, x * x])).toArrow()
    n, both = got["n"].to_numpy(), matrix(got["values"])
    s, ss = np.split(both, 2, axis=1)
    within = (ss - s * s / n[:, None]).sum(0) / max(n.sum() - len(n), 1)
    return s.sum(0) / n.sum(), np.sqrt(np.maximum(within, 0))


def affine(blocks: DataFrame, shift: np.ndarray, factor: np.ndarray) -> DataFrame:
    """values * factor + shift."""
    return transform(blocks, {"values": lambda y: y * factor + shift})


@dataclass
class Merged:
    """Adjusted blocks, the factors, the k used, a score for each k tried, and the positions of the genes left.

    blocks holds the chosen result as values, and where results were named one column for each k.
    """

    blocks: DataFrame
    alpha: np.ndarray
    k: int
    scores: dict[int, float]
    genes: np.ndarray | None = None


def adjust_scaled(blocks: DataFrame, replicate: str, batch: str, controls: np.ndarray, ks: list[int], svd_k: int = 50, cell_type: str | None = "cell_type", names: list[str] | None = None, solver: str = "exact", eta: np.ndarray | None = None, score_cells: int | None = None) -> Merged:
    """Standardise, fit once, adjust for each k, choose the best k by its score, and undo the scaling.

    Without a cell_type the replicates stand in for it in the score. names: a column for the result of each k.
    score_cells: how many cells' silhouettes the score takes (all of them without it).
    """
    if names is not None and len(names) != len(ks):
        raise ValueError("as many result names as values of k are needed")
    mean, sd = scale(blocks, batch)
    sd = np.where(sd > 0, sd, 1.0)
    first = (lambda y: (y - mean) / sd) if eta is None else (lambda y: adjusted(*gene_fit)((y - mean) / sd))
    if eta is not None:
        eta = np.vstack([np.ones(len(controls)), np.atleast_2d(eta)])
        gene_fit = (projector(eta, controls, len(eta)), controls)
    alpha = fit(blocks, replicate, controls, svd_k, solver, max(ks), first)
    step = {k: adjusted(projector(alpha, controls, k), controls) for k in ks}
    scores: dict[int, float] = {}
    if len(ks) > 1:
        kind = cell_type if cell_type and cell_type in blocks.columns else replicate
        tried = transform(blocks, {f"_k{k}": lambda y, k=k: step[k](first(y)) for k in ks})
        found = scores_of(tried, kind, batch, [f"_k{k}" for k in ks], sample=score_cells)
        scores = {k: found[f"_k{k}"] for k in ks}
    best = max(ks, key=lambda k: (scores.get(k, 0.0), -ks.index(k)))
    back = lambda k: lambda y: step[k](first(y)) * sd + mean
    made = {"values": back(best)} | {name: back(k) for name, k in zip(names or [], ks, strict=False)}
    return Merged(transform(blocks, made), alpha, best, scores)


def principal(blocks: DataFrame, n: int = 10) -> np.ndarray:
    """(mean, loadings): the n leading directions of the centred cells, by the covariance Gram."""
    cells, total = total_arrays(blocks)
    m = total / cells
    if len(m) > MAX_GENES:
        return m, leading(lambda q: times(blocks, q, prep=lambda y: y - m), len(m), n, True)[1]
    g = gram(blocks, m=cells // len(m)) - cells * np.outer(m, m)
    return m, np.linalg.eigh(g)[1][:, ::-1][:, :n]


def project(blocks: DataFrame, mean: np.ndarray, load: np.ndarray) -> DataFrame:
    return transform(blocks, {"values": lambda y: (y - mean) @ load})


#: Labels whose sums share a row of a silhouette's exchange; cells by cells whose distances are there at once.
LABELS, ROWS, COLUMNS = 16, 512, 2048


def _by_label(d: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
    """Columns of d added up by code."""
    if width <= 64:
        return d @ (code[:, None] == np.arange(width)).astype(float)
    out, order = np.zeros((len(d), width)), np.argsort(code, kind="stable")
    names, first = np.unique(code[order], return_index=True)
    out[:, names] = np.add.reduceat(d[:, order], first, axis=1)
    return out


def silhouettes(blocks: DataFrame, labels: list[str], arrays: list[str] | None = None, block: int | None = None) -> dict[tuple[str, str], float]:
    """{(array, label): mean Euclidean silhouette}, exact, of several value columns and labels in one pass over pairs.

    Blocks of cells meet each other once, whatever is asked, and their distances count for both; what leaves a task is a
    sum for each cell and label, and tasks are as many as the cores ask for (see pairs). A cell that is alone with its
    label, or whose label is the only one, counts as 0. block: cells of a block.
    """
    arrays = arrays or ["values"]
    base, sizes = blocks.select("cell_id", *(F.col(c).cast("string").alias(f"_n{i}") for i, c in enumerate(labels)), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(arrays))), None
    base = materialize(base, "points")
    for i in range(len(labels)):  # names become numbers: from LABELS of them on another row begins
        found = base.groupBy(F.col(f"_n{i}").alias("_name")).agg(F.count("*").alias("n")).withColumn("code", F.row_number().over(Window.orderBy("_name")) - 1)
        found = materialize(found.withColumn("of", F.lit(i)), "labels")
        base = base.join(found.select("_name", F.col("code").alias(f"_l{i}")), F.col(f"_n{i}").eqNullSafe(F.col("_name"))).drop("_name")
        sizes = found if sizes is None else sizes.unionByName(found)
    base = base.select("cell_id", *(f"_l{i}" for i in range(len(labels))), *(f"_v{i}" for i in range(len(arrays))))
    n, kind, sums = base.count(), dict(blocks.dtypes)["cell_id"], [f"s{i}" for i in range(LABELS)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids, one = table["side"].to_numpy(), table["cell_id"].to_numpy(), table.schema.field("cell_id").type
        codes = [table[f"_l{i}"].to_numpy() for i in range(len(labels))]
        p = np.flatnonzero(side == 0)
        q = p if table["left"][0] == table["right"][0] else np.flatnonzero(side == 1)
        there = {s: [np.unique(c[at], return_inverse=True) for c in codes] for s, at in (("p", p), ("q", q))}

        def out(which: int, i: int, own: np.ndarray, names: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for c in np.unique(names // LABELS):
                some = names // LABELS == c
                wide = np.zeros((len(own), LABELS))
                wide[:, names[some] % LABELS] = total[:, some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), which, np.int32)), pa.array(ids[own], one), pa.array(codes[i][own], pa.int32()), pa.array(np.full(len(own), c, np.int32)), *(pa.array(wide[:, j].copy()) for j in range(LABELS))], ["which", "cell_id", "own", "lot", *sums])

        back = q is not p and len(q) * sum(len(names) for names, _ in there["p"]) * 8 <= HELD  # else distances are taken once for each side
        ways = [(p, q, there["p"], there["q"])] + [(q, p, there["q"], there["p"])] * (q is not p and not back)
        for v in range(len(arrays)) if len(p) and len(q) else []:
            x = matrix(table[f"_v{v}"])
            square = (x**2).sum(1)
            for own, other, by_own, by_other in ways:
                held = [np.zeros((len(other), len(names))) for names, _ in by_own] if back else []
                for a in range(0, len(own), ROWS):
                    at = own[a : a + ROWS]
                    total = [np.zeros((len(at), len(names))) for names, _ in by_other]
                    for b in range(0, len(other), COLUMNS):
                        to = other[b : b + COLUMNS]
                        d = np.sqrt(np.maximum(square[at][:, None] + square[to] - 2 * x[at] @ x[to].T, 0))
                        if q is p:
                            d[at[:, None] == to] = 0
                        for i, t in enumerate(total):
                            t += _by_label(d, by_other[i][1][b : b + COLUMNS], t.shape[1])
                        for i, t in enumerate(held):
                            t[b : b + COLUMNS] += _by_label(d.T, by_own[i][1][a : a + ROWS], t.shape[1])
                    for i, t in enumerate(total):
                        yield from out(v * len(labels) + i, i, at, by_other[i][0], t)
                for i, t in enumerate(held):
                    for b in range(0, len(other), COLUMNS):
                        yield from out(v * len(labels) + i, i, other[b : b + COLUMNS], by_own[i][0], t[b : b + COLUMNS])

    dealt_out = dealt(base.withColumn("_all", F.lit(0)), {0: n}, False, block or block_cells(base, n, "_v0"), "_all") if n else None
    if dealt_out is None:
        return {}
    parts = dealt_out.groupBy("left", "right").applyInArrow(part, f"which int, cell_id {kind}, own int, lot int, " + ", ".join(f"{c} double" for c in sums))
    total = parts.groupBy("which", "cell_id", "own", "lot").agg(*(F.sum(c).alias(c) for c in sums))
    rows = sizes.groupBy(F.col("of"), F.floor(F.col("code") / LABELS).cast("int").alias("lot")).agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("there"))
    known = total.withColumn("of", F.col("which") % len(labels)).join(rows, ["of", "lot"])
    each = F.zip_with("there", F.slice(F.array(*sums), 1, F.size("there")), lambda t, s: F.struct((t["code"] == F.col("own")).alias("mine"), t["n"].alias("n"), s.alias("s")))
    known = known.select("which", "cell_id", each.alias("each"))
    mine, rest = F.filter("each", lambda x: x["mine"]), F.filter("each", lambda x: ~x["mine"])
    known = known.select("which", "cell_id", F.get(mine, F.lit(0)).alias("m"), F.array_min(F.transform(rest, lambda x: x["s"] / x["n"])).alias("b"))
    per = known.groupBy("which", "cell_id").agg(F.max(F.col("m.s") / F.greatest(F.col("m.n") - 1, F.lit(1))).alias("a"), F.max("m.n").alias("n"), F.min("b").alias("b"))
    top = F.greatest("a", "b")
    value = F.when((F.col("n") == 1) | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.when(top != 0, top))
    return {(arrays[r["which"] // len(labels)], labels[r["which"] % len(labels)]): r["v"] for r in per.groupBy("which").agg(F.avg(value).alias("v")).collect()}


def silhouette(blocks: DataFrame, label: str, block: int | None = None) -> float:
    """Mean Euclidean silhouette, exact."""
    return silhouettes(blocks, [label], block=block)["values", label]


def sampled_silhouettes(blocks: DataFrame, labels: list[str], arrays: list[str] | None = None, sample: int = 2000, seed: int = 1) -> dict[tuple[str, str], tuple[float, float]]:
    """{(array, label): (estimate, standard error)} of the mean silhouette: about `sample` cells, by a hash of their id, are
    compared with all cells, so each one's own value is exact. One pass without an exchange of cells; work grows with the cells, not their square.
    """
    arrays = arrays or ["values"]
    n = blocks.count()
    base = blocks.select("cell_id", *(F.col(c).cast("string").alias(f"_l{i}") for i, c in enumerate(labels)), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(arrays)))
    order = F.xxhash64("cell_id", F.lit(seed))
    few = base.orderBy(order, "cell_id").limit(min(n, sample)).toArrow() if n else None
    if few is None:
        return {}
    names = [few[f"_l{i}"].to_pylist() for i in range(len(labels))]
    xs = [matrix(few[f"_v{v}"]) for v in range(len(arrays))]
    sent = blocks.sparkSession.sparkContext.broadcast(xs)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            for v, x in enumerate(sent.value):
                y = matrix(rb.column(f"_v{v}"))
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
                for i in range(len(labels)):
                    lab = np.array(rb.column(f"_l{i}").to_pylist(), object)
                    for one in dict.fromkeys(lab.tolist()):
                        key, at = (v * len(labels) + i, one), lab == one
                        count, total = held.get(key, (0, 0.0))
                        held[key] = count + int(at.sum()), total + d[:, at].sum(1)
        for (w, one), (count, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([one], pa.string()), pa.array([count], pa.int64()), lists(total.reshape(1, -1))], ["which", "other", "n", "values"])

    got = added(base.drop("cell_id").mapInArrow(part, "which int, other string, n long, values array<double>"), "which", "other").collect()
    out = {}
    for v, array in enumerate(arrays):
        for i, label in enumerate(labels):
            rows = {r["other"]: (r["n"], np.array(r["values"])) for r in got if r["which"] == v * len(labels) + i}
            score = np.zeros(len(xs[v]))
            for j, own in enumerate(names[i]):
                m, total = rows[own]
                others = [t[j] / k for o, (k, t) in rows.items() if o != own]
                if m > 1 and others:
                    a, b = total[j] / (m - 1), min(others)
                    score[j] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
            spread = score.std(ddof=1) if len(score) > 1 else 0.0
            out[array, label] = float(score.mean()), float(spread * np.sqrt(max(1 - len(score) / n, 0) / len(score)))
    return out


def batch_score(blocks: DataFrame, cell_type: str, batch: str, dims: int = 10) -> float:
    """F measure of how well types stay apart and batches don't, on the leading directions."""
    return scores_of(blocks, cell_type, batch, ["values"], dims)["values"]


def scores_of(blocks: DataFrame, cell_type: str, batch: str, arrays: list[str], dims: int = 10, sample: int | None = None) -> dict[str, float]:
    """batch_score of several value columns: directions of each, then one pass over pairs for all of them and both labels.

    sample: cells whose silhouettes are taken (all of them without it).
    """
    loads = {c: principal(blocks.select(F.col(c).alias("values")), dims) for c in arrays}
    keep = [c for c in dict.fromkeys(["cell_id", cell_type, batch])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), *(lists((matrix(rb.column(c)) - loads[c][0]) @ loads[c][1]) for c in arrays)], [*keep, *arrays])

    pcs = blocks.select(*keep, *arrays).mapInArrow(rows, ", ".join([fields(blocks, *keep), *(f"`{c}` array<double>" for c in arrays)]))
    found = silhouettes(pcs, [cell_type, batch], arrays) if sample is None else {k: v[0] for k, v in sampled_silhouettes(pcs, [cell_type, batch], arrays, sample).items()}
    out = {}
    for c in arrays:
        t, b = (found[c, cell_type] + 1) / 2, 1 - (found[c, batch] + 1) / 2
        out[c] = 2 * t * b / (t + b) if t + b else 0.0
    return out


def residual_on(blocks: DataFrame, design: list[str], intercept: bool = True) -> DataFrame:
    """blocks with values less what the design columns (and an intercept) predict of them over all cells; own: as they were."""
    cols = [F.col(c).cast("double") for c in design] + [F.lit(1.0)] * intercept
    if not cols:
        return blocks.withColumn("own", F.col("values"))
    ready = blocks.withColumn("_z", F.array(*cols))
    q = len(cols)
    both = _products(ready.select(F.concat("_z", "values").alias("values")), None, None, lambda x, _: x[:, :q].T @ x, None, 64).reshape(q, -1)
    b = np.linalg.lstsq(both[:, :q], both[:, q:], rcond=None)[0]
    names = [c for c in blocks.columns if c != "values"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                y, z = matrix(rb.column("values")), matrix(rb.column("_z"))
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), rb.column("values"), lists(y - z @ b)], [*names, "own", "values"])

    return ready.mapInArrow(rows, f"{fields(blocks, *names)}, own array<double>, values array<double>")


def control_only(blocks: DataFrame, controls: np.ndarray, k: int, design: list[str] | None = None, intercept: bool = True, eta: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Removal by control genes alone: W from their decomposition, after the design (by default an intercept) is taken
    out of them, and alpha by least squares on W. eta: gene covariates that the controls are regressed on before that."""
    n_ctl = int(controls.sum())
    if k > n_ctl:
        raise ValueError("k is larger than the number of controls")
    start = blocks if eta is None else regress_genes(blocks.withColumn("_raw", F.col("values")), eta, controls)
    held = residual_on(start, design or [], intercept)
    g = _products(held, None, None, lambda x, _: x[:, controls].T @ x, None, 64).reshape(n_ctl, -1)
    value, v = np.linalg.eigh(g[:, controls])
    v, d = v[:, ::-1][:, :k], np.sqrt(np.maximum(value[::-1][:k], 1e-300))
    w = v / d  # W = Y_c w has orthonormal columns
    alpha = w.T @ g
    p, names = w @ alpha, [c for c in blocks.columns if c != "values"]
    raw = "own" if eta is None else "_raw"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), lists(matrix(rb.column(raw)) - matrix(rb.column("values"))[:, controls] @ p)], [*names, "values"])

    return held.mapInArrow(rows, f"{fields(blocks, *names)}, values array<double>"), alpha
