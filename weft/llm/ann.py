"""Approximate nearest neighbours: low-dimensional stable projections, indexed by kd-trees.

Vectors are scaled to unit length, so that the largest cosine is the least distance, and projected by one Gaussian
(2-stable) matrix. A tree over a bounded sample cuts the projected space into cells, each vector goes to its cell, and
every block of a cell has a kd-tree of its own. For a query, projected neighbours come one after the other in increasing
projected distance and are verified on the original vectors, until a chi-square test says that a vector nearer than the
k-th found would, with probability `confidence`, have come by now: projected^2 >= chi2(dims, confidence) * kth^2.

Two passes share what is known: a query first searches its own cell; the k-th distance found there bounds the search of
every other block, and cells beyond it by the same test are not asked at all. A block stays in one place and its queries
run past it, so memory is a block and a batch of queries. The sample (SAMPLE_PER_CELL vectors a cell, MAX_CELLS cells)
only places the cuts; every vector is indexed. Of a vector that more than k + 1 rows have, the k + 1 smallest ids are
enough for any ranking; the others can't be in one.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as query or as
candidate, nor do rows without an id; lengths that differ from the query's take no part for it; ties go to the smaller
id; fewer than k candidates are all returned. An id that several rows repeat is there once in a ranking, by its nearest
row, and never in its own; query rows that repeat an id share one ranking.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Points of a leaf of a block's tree at most.
LEAF = 512
#: Bounds of the tree over all cells, which the driver builds: cells, and sampled vectors for each.
MAX_CELLS, SAMPLE_PER_CELL = 1024, 32


def chi2_quantile(p: float, dof: int) -> float:
    """The p-quantile of the chi-square distribution, by bisection on its series."""

    def below(x: float) -> float:
        a, h = dof / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-16:
            term *= h / (a + n)
            total += term
            n += 1
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    lo, hi = 1e-9, 20.0 * dof + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


class KdTree:
    """Median splits on the widest axis; leaves of at most `leaf` points; incremental neighbours by a queue of boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points, leaf
        self.nodes: list = []  # (low corner, high corner, left, right, rows)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        p = self.points[rows]
        lo, hi = p.min(0), p.max(0)
        node = len(self.nodes)
        self.nodes.append(None)
        axis = int((hi - lo).argmax())
        if len(rows) <= self.leaf or hi[axis] == lo[axis]:
            self.nodes[node] = (lo, hi, -1, -1, rows)
            return node
        order = rows[np.argpartition(p[:, axis], len(rows) // 2)]
        left, right = self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :])
        self.nodes[node] = (lo, hi, left, right, None)
        return node

    def _gap(self, node: int, q: np.ndarray) -> float:
        lo, hi, *_ = self.nodes[node]
        d = np.maximum(np.maximum(lo - q, q - hi), 0)
        return float(d @ d)

    def neighbours(self, q: np.ndarray, limit) -> Iterator[np.ndarray]:
        """Rows in runs of increasing squared distance to q, as long as it is below limit(), which may fall meanwhile."""
        queue = [(self._gap(self.root, q), self.root)]
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        run = 32
        while queue or len(rows):
            while queue and (not len(rows) or queue[0][0] <= far[min(run, len(far)) - 1]):
                gap, node = heapq.heappop(queue)
                if gap >= limit():
                    queue = []
                    break
                _, _, left, right, held = self.nodes[node]
                if held is None:
                    heapq.heappush(queue, (self._gap(left, q), left))
                    heapq.heappush(queue, (self._gap(right, q), right))
                    continue
                d = self.points[held] - q
                d = np.einsum("ij,ij->i", d, d)
                near = d < limit()
                rows, far = np.concatenate([rows, held[near]]), np.concatenate([far, d[near]])
                o = np.argsort(far, kind="stable")
                rows, far = rows[o], far[o]
            keep = int(np.searchsorted(far, limit()))
            rows, far = rows[:keep], far[:keep]
            if len(rows):
                yield rows[:run]
                rows, far = rows[run:], far[run:]
                run = min(2 * run, 512)


def cuts(points: np.ndarray, cells: int) -> list:
    """A tree of median cuts as (axis, value, left, right) by node, or the number of a cell (as its complement)."""
    nodes: list = []
    made = 0

    def build(rows: np.ndarray, n: int) -> int:
        nonlocal made
        node = len(nodes)
        nodes.append(None)
        p = points[rows]
        axis = int((p.max(0) - p.min(0)).argmax()) if len(rows) else 0
        value = float(np.median(p[:, axis])) if len(rows) else 0.0
        low = p[:, axis] < value if len(rows) else np.zeros(0, bool)
        if n < 2 or not low.any() or low.all():
            nodes[node] = ~made
            made += 1
        else:
            nodes[node] = (axis, value, build(rows[low], n // 2), build(rows[~low], n - n // 2))
        return node

    build(np.arange(len(points)), cells)
    return nodes


def cell_of(nodes: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    stack = [(0, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if isinstance(nodes[node], int):
            out[rows] = ~nodes[node]
        else:
            axis, value, left, right = nodes[node]
            low = points[rows, axis] < value
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def cells_within(nodes: list, q: np.ndarray, limit: float) -> list[int]:
    """Cells whose squared gap to q is below limit."""
    out, stack = [], [(0, 0.0, np.zeros(len(q)))]
    while stack:
        node, gap, off = stack.pop()
        if isinstance(nodes[node], int):
            out.append(~nodes[node])
            continue
        axis, value, left, right = nodes[node]
        near, far = (left, right) if q[axis] < value else (right, left)
        stack.append((near, gap, off))
        step = abs(q[axis] - value)
        beyond = gap - off[axis] ** 2 + max(step, off[axis]) ** 2
        if beyond < limit:
            more = off.copy()
            more[axis] = max(step, off[axis])
            stack.append((far, beyond, more))
    return sorted(out)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x scaled by powers of two so that no square overflows or vanishes, and the lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def matrix_of(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def project(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    x, norm = units(x)
    return (x / norm[:, None]) @ matrix_of(x.shape[1], dims, seed)


def _by_width(rb: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    width = rb.column("width").to_numpy()
    for w in np.unique(width):
        yield int(w), np.flatnonzero(width == w)


def _placed(trees: dict, dims: int, seed: int):
    """Appends each row's cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cell = np.zeros(rb.num_rows, np.int32)
            for w, pick in _by_width(rb):
                cell[pick] = cell_of(trees.get(w, [~0]), project(rows_of(rb.column("embedding").take(pa.array(pick)), w), dims, seed))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell, pa.int32())], [*rb.schema.names, "cell"])

    return rows


def _asked(trees: dict, dims: int, seed: int, quantile: float):
    """A row for each further cell (`to`) that the query has to ask."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at, to = [], []
            home, least = rb.column("cell").to_numpy(), rb.column("least").to_numpy(zero_copy_only=False)
            for w, pick in _by_width(rb):
                proj = project(rows_of(rb.column("embedding").take(pa.array(pick)), w), dims, seed)
                for r, q in zip(pick, proj, strict=True):
                    limit = np.inf if np.isnan(least[r]) else quantile * max(0.0, 2 - 2 * least[r])
                    more = [c for c in cells_within(trees.get(w, [~0]), q, limit) if c != home[r]]
                    at += [r] * len(more)
                    to += more
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in rb.columns), pa.array(to, pa.int32())], [*rb.schema.names, "to"])

    return rows


def _search(k: int, dims: int, confidence: float, seed: int):
    """Best k of a block for each query of it. Rows come by block, its vectors before its queries."""
    quantile = chi2_quantile(confidence, dims)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        x = norm = ids = None
        for rb in batches:
            key = np.stack([rb.column(c).to_numpy() for c in ("width", "cell", "part")], 1)
            ask = rb.column("is_query").to_numpy(zero_copy_only=False)
            vec_id, qk = rb.column("vec_id").to_numpy(), rb.column("qk").to_numpy()
            floor = rb.column("least").to_numpy(zero_copy_only=False)
            edge = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]), len(key)] if len(key) else []
            out: list = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                w = int(key[a, 0])
                if now != (mine := tuple(key[a])):
                    now, held, tree = mine, [], None
                base = np.flatnonzero(~ask[a:b]) + a
                if len(base):
                    held.append((vec_id[base], rows_of(rb.column("embedding").take(pa.array(base)), w)))
                asks = np.flatnonzero(ask[a:b]) + a
                if not len(asks) or not held:
                    continue
                if tree is None:
                    ids = np.concatenate([h[0] for h in held])
                    x, norm = units(np.concatenate([h[1] for h in held]))
                    tree = KdTree((x / norm[:, None]) @ matrix_of(w, dims, seed))
                y, length = units(rows_of(rb.column("embedding").take(pa.array(asks)), w))
                proj = (y / length[:, None]) @ matrix_of(w, dims, seed)
                for i, r in enumerate(asks):
                    best, score, seen = np.zeros(0, np.int64), np.zeros(0), 0
                    least = -np.inf if np.isnan(floor[r]) else floor[r]
                    limit = lambda: quantile * max(0.0, 2 - 2 * least) if least > -np.inf else np.inf  # noqa: B023, E731
                    for new in tree.neighbours(proj[i], limit):
                        seen += len(new)
                        got = (x[new] @ y[i]) / (norm[new] * length[i])
                        near = (got >= least) & (ids[new] != vec_id[r])
                        if not near.any():
                            continue
                        best, score = np.r_[best, ids[new[near]]], np.r_[score, got[near]]
                        o = np.lexsort((best, -score))
                        first = np.sort(np.unique(best[o], return_index=True)[1])[:k]  # an id once, by its nearest row
                        best, score = best[o][first], score[o][first]
                        if len(best) == k:
                            least = max(least, score[-1])
                    out += [(vec_id[r], qk[r], v, s, 0) for v, s in zip(best, score, strict=True)]
                    out.append((vec_id[r], qk[r], None, None, seen))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "qk", "vec_id", "score", "verified"])

    return rows


def searched(vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = 24, confidence: float = 0.92, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, qk, vec_id, score, verified): the best of each block asked, and a row a block with the vectors verified."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        got = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
        return got.select("vec_id", "embedding", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("qk"))

    spark = vectors.sparkSession
    base, ask = usable(vectors), usable(queries).dropDuplicates(["vec_id", "qk"])
    hot = materialize(base.groupBy("qk").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("qk"), "hot-vectors")
    few = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    warm = base.join(hot, "qk", "left_semi").dropDuplicates(["vec_id", "qk"]).withColumn("r", few).where(f"r <= {k + 1}")
    base = base.join(hot, "qk", "left_anti").select("vec_id", "embedding", "width", "qk").unionByName(warm.drop("r"))
    cells = min(MAX_CELLS, max(1, -(-vectors.count() // block)))
    sample = base.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells * SAMPLE_PER_CELL).select("width", "embedding").collect()
    trees = {}
    for w in {r[0] for r in sample}:
        trees[w] = cuts(project(np.array([r[1] for r in sample if r[0] == w], np.float64), dims, seed), cells)
    plain = "vec_id long, embedding array<double>, width int, qk long"
    placed = materialize(base.mapInArrow(_placed(trees, dims, seed), f"{plain}, cell int"), "vectors")
    home = materialize(ask.select("vec_id", "embedding", "width", "qk").mapInArrow(_placed(trees, dims, seed), f"{plain}, cell int"), "queries")
    size = materialize(placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "cells")
    blocks = placed.join(size, ["width", "cell"]).select("width", "cell", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_query"), "vec_id", "qk", F.lit(None).cast("double").alias("least"), "embedding")
    n = int(size.agg(F.sum("parts")).first()[0] or 1)

    def visit(asked: DataFrame) -> DataFrame:
        sent = asked.join(size, ["width", "cell"]).select("width", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_query"), "vec_id", "qk", "least", "embedding")
        order = ["width", "cell", "part"]
        met = blocks.unionByName(sent).repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), *order).sortWithinPartitions(*order, "is_query", "vec_id", "qk")
        return met.mapInArrow(_search(k, dims, confidence, seed), "query_id long, qk long, vec_id long, score double, verified long")

    near = materialize(visit(home.withColumn("least", F.lit(None).cast("double"))), "near")
    kth = near.where("vec_id is not null").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id"))).where(f"r = {k}").select(F.col("query_id").alias("vec_id"), "qk", F.col("score").alias("least"))
    known = home.join(kth, ["vec_id", "qk"], "left").select("vec_id", "embedding", "width", "qk", "cell", "least")
    asked = known.mapInArrow(_asked(trees, dims, seed, chi2_quantile(confidence, dims)), f"{plain}, cell int, least double, to int")
    return near.unionByName(visit(asked.drop("cell").withColumnRenamed("to", "cell")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query id, its k nearest vectors by cosine. options as of `searched`."""
    found = searched(vectors, queries, k, **options).where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
