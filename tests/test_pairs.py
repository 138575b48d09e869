"""Pairs of blocks: what travels grows with the cells, and results don't depend on the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import linear, matching, neighbours, pairs
from weft.plans import catalogue


def some(spark, n, dims=4, batches=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    rows = [(i, [float(v) for v in r], i % batches, i % 5) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "cell_id long, values array<double>, batch int, cluster int")


def test_cells_travel_as_often_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST", 4)
    for across in (True, False):
        often = []
        for n in (300, 1200):
            df = some(spark, n)[1]
            often.append(pairs.dealt(df, {b: n // 3 for b in range(3)}, across, pairs.block_cells(df, n)).count() / n)
        assert often[1] <= 1.1 * often[0]
    monkeypatch.setattr(pairs, "BYTES", 7 * 4 * 8)
    assert pairs.block_cells(some(spark, 1200)[1], 1200) == 7


@pytest.mark.parametrize("metric", matching.METRICS)
def test_pairs_by_small_blocks_and_tiles(spark, monkeypatch, metric):
    monkeypatch.setattr(matching, "ROWS", 3)
    x, df = some(spark, 40)
    z = x - x.mean(1, keepdims=True) if metric == "cor" else x
    z = z if metric == "euclidean" else z / np.linalg.norm(z, axis=1, keepdims=True)
    want = {(i, j): float(np.linalg.norm(z[i] - z[j]) if metric == "euclidean" else 1 - z[i] @ z[j]) for i in range(40) for j in range(40) if i % 3 < j % 3}
    got = matching.pair_distances(df, metric, block=6).collect()
    assert len(got) == len(want) and all(abs(want[r["cell1"], r["cell2"]] - r["dist"]) < 1e-7 for r in got)
    assert all((r["batch1"], r["cluster1"], r["batch2"], r["cluster2"]) == (r["cell1"] % 3, r["cell1"] % 5, r["cell2"] % 3, r["cell2"] % 5) for r in got)


@pytest.mark.parametrize("metric", matching.METRICS)
def test_distances_in_order_are_the_same(monkeypatch, metric):
    for name, n in (("ROWS", 4), ("COLUMNS", 8), ("PAIRS", 64)):
        monkeypatch.setattr(matching, name, n)
    rng = np.random.default_rng(3)
    p, q = (matching.unit(rng.normal(size=(n, 5)) / 5, metric) for n in (24, 48))
    want = matching.distances(p, q, metric)
    for digits, ordered in ((0, True), (9, False), (18, False)):  # few values; each its own; numbers too large to go beside a place
        got = list(matching._in_order(p, q, metric, digits))
        i, j, d = (np.concatenate(c) for c in zip(*got, strict=True))
        assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(d) == want.size and np.allclose(d, want[i, j])
        assert ordered == any((np.diff(a * 48 + b) < 0).any() for a, b, _ in got)
        assert not ordered or all((np.diff(np.rint(v)) >= 0).all() for *_, v in got)
    assert not list(matching._in_order(p[:0], q, metric, 2)) and not list(matching._in_order(p, q[:0], metric, 2))
    assert matching._order(np.array([np.nan] * 9), 6) is None


@pytest.mark.parametrize("name, apart", [("pairwise_cor_dist", 0.06), ("pairwise_cosine_dist", 0.06), ("pairwise_euclidean_dist", 0.02)])
def test_a_pair_takes_less_than_its_distance_in_a_file(spark, tmp_path, name, apart):
    n = 2040
    x = np.array([0.3, 0.0] * 4) + np.random.default_rng(5).normal(size=(n, 8)) * apart  # a distance of 6 digits comes several times, as among many cells
    spark.createDataFrame([(i // 2 * 3 + i % 2, [float(v) for v in r], i % 7) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    catalogue.queries()[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("cell1", "cell2").distinct().count() == (n // 2) ** 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 8 * (n // 2) ** 2


def test_medians_of_ties_at_edges_of_bins(spark):
    rows = [(i, [float(i // 2 % 5), 0.0], i % 2, 0) for i in range(60)]  # distances 0, 1, 2, 3, 4
    df = spark.createDataFrame(rows, "cell_id long, values array<double>, batch int, cluster int")
    a, b = (np.array([r[1][0] for r in rows if r[2] == s]) for s in (0, 1))
    want = float(np.median(np.abs(a[:, None] - b)))
    for singly in (1, 7, 10**6):
        assert [r["dist"] for r in matching.median_between(df, "euclidean", block=7, singly=singly).collect()] == [want]


@pytest.mark.parametrize("name", ["cluster_median_dist", "mutual_nearest_clusters"])
def test_medians_make_no_row_a_pair(spark, monkeypatch, name):
    def none(*args, **kwargs):
        raise AssertionError("a row for each pair of cells")

    monkeypatch.setattr(matching, "pair_distances", none)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").where(F.col("dist") >= 0).count()


def often(monkeypatch, module, run, frames):
    """Rows that a step deals to pairs of blocks, for each cell, of each frame."""
    monkeypatch.setattr(pairs, "LEAST", 4)
    dealt, seen = pairs.dealt, []

    def counted(points, *args):
        out = dealt(points, *args)
        seen.append(out.count() / points.count())
        return out

    monkeypatch.setattr(module, "dealt", counted)
    for df in frames:
        run(df)
    return seen


def test_silhouettes_deal_each_cell_as_often(spark, monkeypatch):
    seen = often(monkeypatch, linear, lambda df: linear.silhouette(df, "cluster"), [some(spark, n)[1] for n in (300, 900)])
    assert seen[1] <= 1.1 * seen[0]


def test_neighbours_deal_each_cell_as_often(spark, monkeypatch):
    seen = often(monkeypatch, neighbours, lambda df: neighbours.all_pairs(df, 3).count(), [some(spark, n)[1] for n in (300, 900)])
    assert seen[1] <= 1.1 * seen[0]


@pytest.mark.parametrize("held", [linear.HELD, 0])
def test_silhouettes_of_many_labels_and_tiles(spark, monkeypatch, held):
    monkeypatch.setattr(linear, "HELD", held)
    monkeypatch.setattr(linear, "ROWS", 7)
    monkeypatch.setattr(linear, "COLUMNS", 11)
    x, df = some(spark, 220)
    df = df.withColumn("many", F.col("cell_id") % 75).withColumn("own", F.col("cell_id"))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    got = linear.silhouettes(df, ["cluster", "many", "own"], block=90)
    for name, lab in (("cluster", np.arange(220) % 5), ("many", np.arange(220) % 75), ("own", np.arange(220))):
        size = np.bincount(lab)
        mean = np.stack([d[:, lab == c].sum(1) for c in range(len(size))], 1)
        a = mean[np.arange(220), lab] / np.maximum(size[lab] - 1, 1)
        rest = mean / size
        rest[np.arange(220), lab] = np.inf
        s = np.where(size[lab] == 1, 0, (rest.min(1) - a) / np.maximum(rest.min(1), a))
        assert abs(got["values", name] - s.mean()) < 1e-9


def test_neighbours_by_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 5)
    monkeypatch.setattr(neighbours, "COLUMNS", 9)
    x, df = some(spark, 120)
    got = {r["cell_id"]: r["near"] for r in neighbours.merged(neighbours.all_pairs(df, 6, 16), 6).collect()}
    for i in range(120):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert got[i] == [j for j in np.lexsort((np.arange(120), d)).tolist() if j != i and j % 3 == i % 3][:6]
