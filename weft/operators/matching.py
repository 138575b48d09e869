"""Matching of clusters across batches: distances, mutual nearest neighbours, communities, labels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .linear import added, matrix
from .pairs import block_cells, dealt

METRICS = ("cor", "cosine", "euclidean")
#: Cells by cells whose distances are there at once.
ROWS, COLUMNS = 256, 2048
#: Distances that are put in order at once (a power of two); how often a value has to be among them for that.
PAIRS, REPEATS = 1 << 24, 4


def unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cor":
        x = x - x.mean(1, keepdims=True)
    if metric != "euclidean":
        x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
    return x


def distances(p: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    p, q = unit(p, metric), unit(q, metric)
    if metric == "euclidean":
        return np.sqrt(np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1) - 2 * p @ q.T, 0))
    return 1 - p @ q.T


def _sides(blocks: DataFrame, sizes: dict, block: int | None) -> DataFrame:
    """Every cell for each pair of blocks (left, right) it takes part in: blocks of a batch's cells meet those of the others."""
    cells = blocks.select("cell_id", "batch", "cluster", "values")
    return dealt(cells, sizes, True, block or block_cells(cells, sum(sizes.values())))


def _halves(table: pa.Table, metric: str) -> list[tuple]:
    """(ids, batch, cluster, ready values, runs) of the left and of the right of a pair of blocks, sorted by batch and cluster; a run is
    a cluster's (key, first row, row after the last)."""
    table = table.sort_by([(c, "ascending") for c in ("side", "batch", "cluster", "cell_id")])
    side, batch, cluster = (table[c].to_numpy() for c in ("side", "batch", "cluster"))
    x, ids = matrix(table["values"]), table["cell_id"].to_numpy()
    out = []
    for s in (0, 1):
        lo, hi = np.searchsorted(side, [s, s + 1])
        b, c = batch[lo:hi], cluster[lo:hi]
        edge = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (c[1:] != c[:-1])) + 1), hi - lo] if hi > lo else [0]
        keys = list(zip(table["batch"].slice(lo, hi - lo).take(edge[:-1]).to_pylist(), table["cluster"].slice(lo, hi - lo).take(edge[:-1]).to_pylist(), strict=True)) if hi > lo else []
        out.append((ids[lo:hi], b, c, unit(x[lo:hi], metric), list(zip(keys, edge[:-1], edge[1:], strict=True))))
    return out


def _tiles(p: np.ndarray, q: np.ndarray, metric: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of p, first row of q, distances) of ready values, ROWS by COLUMNS at a time."""
    pp, qq = (p**2).sum(1), (q**2).sum(1)
    for i in range(0, len(p), ROWS):
        for j in range(0, len(q), COLUMNS):
            d = p[i : i + ROWS] @ q[j : j + COLUMNS].T
            if metric == "euclidean":
                d = np.sqrt(np.maximum(pp[i : i + ROWS, None] + qq[j : j + COLUMNS] - 2 * d, 0))
            else:
                d = np.maximum(1 - d, 0)
            yield i, j, d


def _in_order(p: np.ndarray, q: np.ndarray, metric: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of p, rows of q, distances) of ready values, PAIRS at most in order of the distances rounded to digits.

    Where few of them are equal, they come by rows of p.
    """
    wide = max(1, min(len(q), PAIRS // ROWS))
    high = max(1, PAIRS // wide // ROWS) * ROWS
    for i in range(0, len(p), high):
        for j in range(0, len(q), wide):
            some, other = p[i : i + high], q[j : j + wide]
            d = np.empty((len(some), len(other)))
            for k, m, tile in _tiles(some, other, metric):
                d[k : k + tile.shape[0], m : m + tile.shape[1]] = tile
            d = d.ravel()
            at = _order(d, digits)
            for k in range(0, len(d), ROWS * COLUMNS):
                some_at = np.arange(k, min(k + ROWS * COLUMNS, len(d))) if at is None else at[k : k + ROWS * COLUMNS]
                yield i + some_at // len(other), j + some_at % len(other), d[some_at]


def _order(d: np.ndarray, digits: int) -> np.ndarray | None:
    """Places of at most PAIRS distances by their rounded values; None if those repeat too seldom or don't fit beside a place."""
    at, lot = np.empty(len(d), np.int64), ROWS * COLUMNS
    for k in range(0, len(d), lot):
        key = np.rint(d[k : k + lot] * 10.0**digits)
        if not key.max() < 2**63 // PAIRS:
            return None
        at[k : k + lot] = key.astype(np.int64) * PAIRS + np.arange(k, k + len(key))
    at.sort()
    values = 1 + sum(int(np.count_nonzero(np.diff(at[k : k + lot + 1] // PAIRS))) for k in range(0, len(at), lot))
    if values * REPEATS > len(at):
        return None
    at %= PAIRS
    return at


def _kinds(blocks: DataFrame) -> tuple[dict, str]:
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return kind, f"batch1 {kind['batch']}, cluster1 {kind['cluster']}, batch2 {kind['batch']}, cluster2 {kind['cluster']}"


def _sizes(blocks: DataFrame) -> dict:
    """Cells by (batch, cluster)."""
    return {(r["batch"], r["cluster"]): r["n"] for r in blocks.groupBy("batch", "cluster").agg(F.count("*").alias("n")).collect()}


def _by_batch(sizes: dict) -> dict:
    out: dict = defaultdict(int)
    for (b, _), n in sizes.items():
        out[b] += n
    return dict(out)


def pair_distances(blocks: DataFrame, metric: str = "cor", block: int | None = None, digits: int | None = None) -> DataFrame:
    """(batch1, cluster1, batch2, cluster2, cell1, cell2, dist) of all cells of different batches, batch1 < batch2.

    blocks(cell_id, batch, cluster, values). A pair of blocks is a task, which gives its rows out tile by tile. block: cells of
    a block; see pairs.block_cells. digits: for who rounds the distances to so many: equal ones come together, as far as they
    are in a task at once, which takes less room in a file than rows by cells, whose distances don't compress.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    kind, keys = _kinds(blocks)
    names = ["batch1", "cluster1", "batch2", "cluster2", "cell1", "cell2", "dist"]

    def by_cells(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, d in _tiles(p, q, metric):
            yield np.repeat(np.arange(i, i + d.shape[0]), d.shape[1]), np.tile(np.arange(j, j + d.shape[1]), d.shape[0]), d.ravel()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        types = [table.schema.field(c).type for c in ("batch", "cluster", "batch", "cluster", "cell_id", "cell_id")] + [pa.float64()]
        (ids1, b1, c1, p, _), (ids2, b2, c2, q, _) = _halves(table, metric)
        for at, to, d in by_cells(p, q) if digits is None else _in_order(p, q, metric, digits):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((b1[at], c1[at], b2[to], c2[to], ids1[at], ids2[to], d), types, strict=True)], names)

    return _sides(blocks, _by_batch(_sizes(blocks)), block).groupBy("left", "right").applyInArrow(rows, f"{keys}, cell1 {kind['cell_id']}, cell2 {kind['cell_id']}, dist double")


def median_distances(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("batch1", "cluster1", "batch2", "cluster2").agg(F.median("dist").alias("dist"))


#: Distances of a pair of clusters that leave the tasks one by one; more are counted in as many bins, again and again.
SINGLY, BINS = 200_000, 8192


def median_between(blocks: DataFrame, metric: str = "cor", block: int | None = None, singly: int = SINGLY) -> DataFrame:
    """(batch1, cluster1, batch2, cluster2, dist): the exact median distance of the cells of two clusters.

    Clusters with many pairs are counted into bins, and the bins around the median are cut up until few distances are
    left in them: what leaves a task does not grow with the pairs, and tasks are as many as the cores ask for (see pairs).
    Only one row a pair of clusters reaches the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    sizes = _sizes(blocks)
    sides = _sides(blocks, _by_batch(sizes), block)
    top = 2.000001 if metric != "euclidean" else 2.000001 * (blocks.agg(F.max(F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 0.0) + 1e-9
    top = float(2.0 ** np.ceil(np.log2(top)))  # from 0 in powers of two, edges of bins and the places of distances in them are exact
    # low, high, below, within, rank: of the lower and the upper median, the range that holds it
    span = {(a, b, r): [0.0, top, 0, n * m, r] for a, n in sizes.items() for b, m in sizes.items() if a[0] < b[0] for r in {(n * m - 1) // 2, n * m // 2}}
    kind, keys = _kinds(blocks)
    names = ["batch1", "cluster1", "batch2", "cluster2", "rank"]

    def ranges(some: dict) -> dict:
        """{pair of clusters: {(low, high): ranks}}: both medians are mostly in one range, which is counted once."""
        out: dict = {}
        for (a, b, r), (low, high, *_) in some.items():
            out.setdefault((a, b), {}).setdefault((low, high), []).append(r)
        return out

    def each(table: pa.Table, asked: dict):
        """(clusters, low, high, ranks, tiles of distances) of all that is asked of a pair of blocks."""
        (*_, p, left), (*_, q, right) = _halves(table, metric)
        for a, i, to_i in left:
            for b, j, to_j in right:
                for (low, high), ranks in asked.get((a, b), {}).items():
                    yield (*a, *b), low, high, ranks, (d for _, _, d in _tiles(p[i:to_i], q[j:to_j], metric))

    def made(table: pa.Table, out: list[tuple]) -> pa.Table:
        kinds = [table.schema.field(c).type for c in ("batch", "cluster")] * 2 + [pa.int64(), pa.int64()]
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        flat = pa.array(np.concatenate(cols[-1]) if out else [], pa.float64())
        ends = pa.array(np.r_[0, np.cumsum([len(v) for v in cols[-1]])].astype(np.int32) if out else [0], pa.int32())
        return pa.table([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), pa.ListArray.from_arrays(ends, flat)], names=[*names, "n", "values"])

    schema = f"{keys}, rank long, n long, values array<double>"
    # every pass makes a range BINS times as narrow, down to what rounding leaves of it, so ties end it as well
    while wide := {k: v for k, v in span.items() if v[3] > singly and v[1] - v[0] > 2e-13 * BINS * top}:
        asked = ranges(wide)

        def counts(table: pa.Table) -> pa.Table:
            out = []
            for key, low, high, ranks, tiles in each(table, asked):  # noqa: B023
                total, by = np.zeros(BINS, np.int64), BINS / (high - low)
                for d in tiles:
                    some = d.ravel() if low == 0 and high == top else d[(d >= low) & (d < high)]  # at first all of them
                    total += np.bincount(np.minimum(((some - low) * by).astype(np.int64), BINS - 1), minlength=BINS)
                out.append((*key, min(ranks), 1, total.astype(float)))
            return made(table, out)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for row in rb.to_pylist():
                    a, b = (row["batch1"], row["cluster1"]), (row["batch2"], row["cluster2"])
                    count = np.cumsum(np.asarray(row["values"], float)).astype(np.int64)
                    out = []
                    for rank in next(v for v in asked[a, b].values() if min(v) == row["rank"]):  # noqa: B023
                        i = min(int(np.searchsorted(wide[a, b, rank][2] + count, rank, "right")), BINS - 1)  # noqa: B023
                        out.append((rank, i, int(count[i - 1]) if i else 0, int(count[i]) - (int(count[i - 1]) if i else 0)))
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[c]] * len(out), rb.schema.field(c).type) for c in names[:4]), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], [*names, "bin", "below", "within"])

        total = added(sides.groupBy("left", "right").applyInArrow(counts, schema), *names)
        for r in total.mapInArrow(found, f"{keys}, rank long, bin long, below long, within long").collect():
            at = span[(r["batch1"], r["cluster1"]), (r["batch2"], r["cluster2"]), r["rank"]]
            step = (at[1] - at[0]) / BINS
            low = at[0] + r["bin"] * step
            at[:4] = low, low + step, at[2] + r["below"], r["within"]

    last = ranges(span)

    def left_over(table: pa.Table) -> pa.Table:
        out = []
        for key, low, high, ranks, tiles in each(table, last):
            held = np.concatenate([d[(d >= low) & (d < high)] for d in tiles])
            if span[key[:2], key[2:], ranks[0]][3] > singly:  # of one value, as far as numbers tell
                held = held[:1]
            out.append((*key, ranks[0], 1, held))
        return made(table, out)

    rows = sides.groupBy("left", "right").applyInArrow(left_over, schema)
    few = materialize(rows, "distances").groupBy(*names).agg(F.sort_array(F.flatten(F.collect_list("values"))).alias("d"))  # `singly` at most
    known = [(*a, *b, ranks[0], 0 if span[a, b, r][3] > singly else r - span[a, b, r][2]) for (a, b), asked in last.items() for ranks in asked.values() for r in ranks]
    places = blocks.sparkSession.createDataFrame(known, f"{keys}, rank long, place long")
    nth = F.element_at("d", F.least(F.col("place") + 1, F.size("d")).cast("int"))
    return few.where(F.size("d") > 0).join(places, names).groupBy(*names[:4]).agg(F.avg(nth).alias("dist"))


def mutual_nearest(medians: DataFrame, digits: int = 9) -> DataFrame:
    """Rows of medians where each cluster is the other's nearest in that batch; ties go to the smaller cluster."""
    d = F.round("dist", digits)
    a = F.row_number().over(Window.partitionBy("batch1", "batch2", "cluster1").orderBy(d, "cluster2"))
    b = F.row_number().over(Window.partitionBy("batch1", "batch2", "cluster2").orderBy(d, "cluster1"))
    return medians.withColumn("_a", a).withColumn("_b", b).where("_a = 1 and _b = 1").drop("_a", "_b")


def nearest_batches(medians: DataFrame, digits: int = 9) -> DataFrame:
    """Where every batch has one cluster: pairs of batches that are each other's nearest."""
    flipped = medians.select(F.col("batch2").alias("batch1"), F.col("cluster2").alias("cluster1"), F.col("batch1").alias("batch2"), F.col("cluster1").alias("cluster2"), "dist")
    best = medians.unionByName(flipped).withColumn("_r", F.row_number().over(Window.partitionBy("batch1").orderBy(F.round("dist", digits), "batch2"))).where("_r = 1").drop("_r")
    back = best.select(F.col("batch1").alias("y"), F.col("batch2").alias("x"))
    return best.join(back, (best["batch1"] == back["x"]) & (best["batch2"] == back["y"]), "left_semi").where("batch1 < batch2")


def communities(nodes: list, edges: list[tuple]) -> dict:
    """Greedy modularity: merge the pair of communities that raises modularity most, while any does. Numbered by least node.

    Nodes are clusters, so this is a small graph on the driver.
    """
    m = len(set(map(frozenset, edges)))
    of = {n: i for i, n in enumerate(sorted(nodes))}
    degree, between = defaultdict(float), defaultdict(float)
    for pair in sorted(set(map(lambda e: tuple(sorted(e)), edges))):
        a, b = of[pair[0]], of[pair[1]]
        degree[a] += 1
        degree[b] += 1
        between[a, b] += 1
    member = {i: {n} for n, i in of.items()}
    while between:
        gain, pair = max(((w / m - degree[a] * degree[b] / (2 * m * m)), (-a, -b)) for (a, b), w in between.items())
        if gain <= 1e-12:
            break
        a, b = -pair[0], -pair[1]
        member[a] |= member.pop(b)
        degree[a] += degree.pop(b)
        merged: defaultdict = defaultdict(float)
        for (x, y), w in between.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                merged[min(x, y), max(x, y)] += w
        between = merged
    groups = sorted((min(v), v) for v in member.values())
    return {n: g for g, (_, v) in enumerate(groups, 1) for n in v}


def match_clusters(blocks: DataFrame, metric: str = "euclidean") -> DataFrame | None:
    """(grp, batch, cluster): groups of clusters that match across batches; None for two batches of one cluster each.

    Batches of one cluster match only those of several, unless all have one.
    """
    spark = blocks.sparkSession
    nodes = [tuple(r) for r in blocks.select("batch", "cluster").distinct().collect()]
    count = defaultdict(int)
    for b, _ in nodes:
        count[b] += 1
    single = {b for b, c in count.items() if c == 1}
    if len(single) == len(count) == 2:
        return None
    medians = materialize(median_between(blocks, metric), "medians")
    if len(single) == len(count):
        found = nearest_batches(medians)
    else:
        found = mutual_nearest(medians.where(~(F.col("batch1").isin(list(single)) & F.col("batch2").isin(list(single)))) if single else medians)
    edges = [((r["batch1"], r["cluster1"]), (r["batch2"], r["cluster2"])) for r in found.collect()]
    group = communities(nodes, edges)
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return spark.createDataFrame([(g, *n) for n, g in group.items()], f"grp int, batch {kind['batch']}, cluster {kind['cluster']}")


def match_labels(cells: DataFrame, matched: DataFrame | None, prop: float = 1.0) -> DataFrame:
    """cells(cell_id, batch, cluster, dist_prop) with replicate: the group's label for core cells, else the cell's own.

    Without a match table each batch's cluster is a group of its own.
    """
    if matched is None:
        label = F.concat_ws("_", F.lit("Replicate"), "batch", "cluster")
        joined = cells.withColumn("label", label)
    else:
        joined = cells.join(matched, ["batch", "cluster"], "left").withColumn("label", F.when(F.col("grp").isNotNull(), F.concat(F.lit("Replicate_"), "grp")))
    core = F.col("label").isNotNull() & (F.col("dist_prop") <= prop)
    return joined.select(*cells.columns, F.when(core, F.col("label")).otherwise(F.concat(F.lit("cell:"), "cell_id")).alias("replicate"))
