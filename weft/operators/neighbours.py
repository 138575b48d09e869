"""Nearest cells within each batch, over partitions: all pairs of blocks, or a forest and an exchange between neighbours.

The forest: every tree cuts a batch by the medians of random directions, taken from a bounded sample; cells are dealt to
(batch, tree, leaf) and compared within. A leaf that holds more cells than wanted (copies, or more cells than the sample
foresaw) is dealt on by a hash, so no leaf is larger than its bound. The exchange: a cell's neighbours, and the cells it
is a neighbour of, are compared with each other; cells that very many have as a neighbour are dealt out too.

Defined cases: a batch of one cell has no neighbours; equal distances go by cell id; fewer cells than k give as many
neighbours as there are others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .linear import fields, lists, matrix
from .pairs import block_cells, dealt

#: Cells of a batch that the cuts of its trees are taken from; members of a group of an exchange.
SAMPLE, GROUP = 4096, 128
#: Cells by cells that all pairs compare at once.
ROWS, COLUMNS = 512, 4096
TREES, LEAF = 12, 256
#: Directions of a level; nodes beyond share them.
WAYS = 64


def _top(x: np.ndarray, ids: np.ndarray, y: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id of a near one, distance) of each row of x among y: k each, not itself; distances by differences."""
    d = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T
    d[ids[:, None] == other] = np.inf
    some = min(k + 4, len(other))  # a few more, as the distances of products are rounded
    near = np.argpartition(d, some - 1, 1)[:, :some]
    row = np.repeat(np.arange(len(x)), some)
    near = near.ravel()
    fine = np.isfinite(d[row, near])
    row, near = row[fine], near[fine]
    exact = np.sqrt(((x[row] - y[near]) ** 2).sum(1))
    order = np.lexsort((other[near], exact, row))
    row, near, exact = row[order], near[order], exact[order]
    first = np.searchsorted(row, np.arange(len(x)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], other[near[keep]], exact[keep]


def _rows(table: pa.Table, kind: pa.DataType, a: np.ndarray, b: np.ndarray, d: np.ndarray, batch) -> pa.Table:
    return pa.table({"batch": pa.array([batch] * len(a), table.schema.field("batch").type), "cell_id": pa.array(a, kind), "other": pa.array(b, kind), "dist": pa.array(d, pa.float64())})


def _schema(points: DataFrame) -> str:
    kind = dict(points.dtypes)
    return f"batch {kind['batch']}, cell_id {kind['cell_id']}, other {kind['cell_id']}, dist double"


def all_pairs(points: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Candidates (batch, cell_id, other, dist): each cell's k nearest in every block of its batch.

    Two blocks meet once, for the neighbours of both; see pairs. block: cells of a block.
    """
    cells = points.select("batch", "cell_id", "values")
    sizes = {r["batch"]: r["n"] for r in cells.groupBy("batch").agg(F.count("*").alias("n")).collect()}

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids, x = table["side"].to_numpy(), table["cell_id"].to_numpy(), matrix(table["values"])
        p = np.flatnonzero(side == 0)
        q = p if table["left"][0] == table["right"][0] else np.flatnonzero(side == 1)
        kind, batch = table.schema.field("cell_id").type, table["batch"][0].as_py()
        for own, other in ([(p, p)] if q is p else [(p, q), (q, p)]) if len(p) and len(q) else []:
            for i in range(0, len(own), ROWS):
                at = own[i : i + ROWS]
                row, near, d = _near(x[at], ids[at], x[other], ids[other], k)
                yield from _rows(table, kind, ids[at][row], near, d, batch).to_batches()

    sides = dealt(cells, sizes, False, block or block_cells(cells, sum(sizes.values())))
    return sides.groupBy("left", "right").applyInArrow(pair, _schema(points))


def _near(x: np.ndarray, ids: np.ndarray, y: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_top of few rows among many, COLUMNS at a time: the nearest of each lot, and the nearest of those."""
    lots = [_top(x, ids, y[j : j + COLUMNS], other[j : j + COLUMNS], k) for j in range(0, len(y), COLUMNS)]
    if len(lots) == 1:
        return lots[0]
    row, near, d = (np.concatenate(c) for c in zip(*lots, strict=True))
    order = np.lexsort((near, d, row))
    row, near, d = row[order], near[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row] < k
    return row[keep], near[keep], d[keep]


def _cuts(points: DataFrame, trees: int, leaf: int, seed: int) -> dict:
    """{batch: (cuts of each tree)}: a tree is a list of levels; a level has a direction and a cut for each of its nodes."""
    size = {r["batch"]: r["n"] for r in points.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    known = points.sparkSession.createDataFrame([(b, min(1.0, SAMPLE / n)) for b, n in size.items()], f"{fields(points, 'batch')}, rate double")
    drawn = points.join(known, "batch").where((F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < F.col("rate"))
    sample: dict = {b: [] for b in size}
    for r in drawn.select("batch", "values").orderBy("batch", "cell_id").toLocalIterator():
        if len(sample[r["batch"]]) < 2 * SAMPLE:
            sample[r["batch"]].append(r["values"])
    out = {}
    for i, b in enumerate(sorted(sample, key=str)):
        x = np.array(sample[b])
        depth = max(0, int(np.ceil(np.log2(max(size[b], 1) / leaf)))) if len(x) > 1 else 0
        depth = min(depth, int(np.log2(max(len(x), 1))))
        rng = np.random.default_rng([seed, i])
        forest = []
        for _ in range(trees):
            node, levels = np.zeros(len(x), int), []
            for level in range(depth):
                way = rng.standard_normal((x.shape[1], min(1 << level, WAYS)))
                score = (x * way.T[node % WAYS]).sum(1)
                cut = np.array([np.median(score[node == n]) if (node == n).any() else 0.0 for n in range(1 << level)])
                levels.append((way, cut))
                node = 2 * node + (score > cut[node])
            forest.append(levels)
        out[b] = forest
    return out


def by_forest(points: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> DataFrame:
    """Candidates (batch, cell_id, other, dist) that share a leaf of some tree."""
    sent = points.sparkSession.sparkContext.broadcast(_cuts(points, trees, leaf, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            x, batch = matrix(rb.column("values")), np.array(rb.column("batch").to_pylist(), object)
            where = np.zeros((len(x), trees), np.int64)
            for b in dict.fromkeys(batch.tolist()):
                at = np.flatnonzero(batch == b)
                for t, levels in enumerate(sent.value[b]):
                    node = np.zeros(len(at), int)
                    for way, cut in levels:
                        node = 2 * node + ((x[at] * way.T[node % WAYS]).sum(1) > cut[node])
                    where[at, t] = node
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * trees, pa.int32()), pa.array(where.ravel()))], [*rb.schema.names, "leaves"])

    named = points.select("batch", "cell_id", "values").mapInArrow(deal, f"{fields(points, 'batch', 'cell_id')}, values array<double>, leaves array<long>")
    named = materialize(named, "leaves")
    dealt = named.select("batch", "cell_id", "values", F.posexplode("leaves").alias("tree", "leaf"))
    size = named.select("batch", F.posexplode("leaves").alias("tree", "leaf")).groupBy("batch", "tree", "leaf").agg(F.ceil(F.count("*") / (2.0 * leaf)).cast("int").alias("parts"))
    dealt = dealt.join(size, ["batch", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("cell_id", "tree"), F.col("parts")))

    def within(table: pa.Table) -> pa.Table:
        ids, x = table["cell_id"].to_numpy(), matrix(table["values"])
        row, other, d = _top(x, ids, x, ids, k)
        return _rows(table, table.schema.field("cell_id").type, ids[row], other, d, table["batch"][0].as_py())

    return dealt.drop("parts").groupBy("batch", "tree", "leaf", "part").applyInArrow(within, _schema(points))


def merged(found: DataFrame, k: int) -> DataFrame:
    """(batch, cell_id, near): the k nearest of a cell's candidates, nearest first; a pair found more than once counts once."""
    some = found.groupBy("batch", "cell_id").agg(F.sort_array(F.collect_list(F.struct("dist", "other"))).alias("all"))
    return some.select("batch", "cell_id", F.slice(F.array_distinct(F.transform("all", lambda x: x["other"])), 1, k).alias("near"))


def exchange(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Candidates among cells that share a neighbour, or are neighbours of each other."""
    out = near.select("batch", F.col("cell_id").alias("centre"), F.explode("near").alias("cell_id"))
    back = near.select("batch", F.explode("near").alias("centre"), "cell_id")
    own = near.select("batch", F.col("cell_id").alias("centre"), "cell_id")
    member = out.unionByName(back).unionByName(own).distinct()
    parts = member.groupBy("batch", "centre").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    dealt = member.join(parts, ["batch", "centre"]).withColumn("part", F.pmod(F.xxhash64("cell_id", "centre"), F.col("parts")))
    full = dealt.join(points.select("batch", "cell_id", "values"), ["batch", "cell_id"]).select("batch", "centre", "part", "cell_id", "values")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def out_() -> pa.RecordBatch:
            x, own = np.array(rows), np.array(ids)
            row, other, d = _top(x, own, x, own, k)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(row), kinds[0]), pa.array(own[row], kinds[1]), pa.array(other, kinds[1]), pa.array(d)], ["batch", "cell_id", "other", "dist"])

        for rb in batches:
            kinds = rb.schema.field("batch").type, rb.schema.field("cell_id").type
            x = matrix(rb.column("values"))
            for i, key in enumerate(zip(*(rb.column(c).to_pylist() for c in ("batch", "centre", "part", "cell_id")), strict=True)):
                if key[:3] != now:
                    if len(ids) > 1:
                        yield out_()
                    now, ids, rows = key[:3], [], []
                ids.append(key[3])
                rows.append(x[i])
        if len(ids) > 1:
            yield out_()

    return full.repartition("batch", "centre", "part").sortWithinPartitions("batch", "centre", "part").mapInArrow(groups, _schema(points))


def nearest_cells(points: DataFrame, k: int, back_end: str = "exact", trees: int = TREES, leaf: int = LEAF, rounds: int = 1, seed: int = 1) -> DataFrame:
    """(batch, cell_id, near): each cell's k nearest others of its batch. points(cell_id, batch, values)."""
    if back_end == "exact":
        return materialize(merged(all_pairs(points, k), k), "near")
    found = materialize(by_forest(points, k, trees, max(leaf, 2 * k + 2), seed), "candidates")
    for _ in range(rounds):
        near = merged(found, k)
        found = materialize(found.unionByName(exchange(points, near, k)), "candidates")
    return materialize(merged(found, k), "near")
