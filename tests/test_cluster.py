"""Distributed clustering against plain versions of the same."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import cluster, communities, kmeans, linear, neighbours, pca


def frame(spark, x, batch, parts=3):
    rows = [(i, b, [float(v) for v in r]) for i, (r, b) in enumerate(zip(x, batch, strict=True))]
    return spark.createDataFrame(rows, "cell_id long, batch string, values array<double>").repartition(parts).cache()


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(5, 6)) * 4, 30, 0) + rng.normal(size=(150, 6))
    return x, frame(spark, x, ["a" if i % 3 else "b" for i in range(150)])


def labels(df):
    return {r["cell_id"]: r["cluster"] for r in df.collect()}


@pytest.mark.parametrize("most", [4096, 3])
def test_scores_are_those_of_each_batch(cells, monkeypatch, most):
    x, df = cells
    monkeypatch.setattr(linear, "MAX_GENES", most)
    wide = df.withColumn("values", F.concat("values", F.array(F.lit(2.0))))  # a column that doesn't vary
    got = {r["cell_id"]: r["values"] for r in pca.batch_scores(wide, 4).collect()}
    for b in (0, 1):
        at = [i for i in range(150) if bool(i % 3) == bool(b)]
        z = (x[at] - x[at].mean(0)) / x[at].std(0, ddof=1)
        want = z @ np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :4]
        assert np.allclose(np.abs([got[i] for i in at]), np.abs(want), atol=1e-6)


def test_scores_of_odd_batches(spark):
    df = frame(spark, np.array([[1.0, 2], [3, 4], [3, 4], [5, 1]]), ["one", "same", "same", "x"])
    assert all(v == 0 for r in pca.batch_scores(df, 3).collect() for v in r["values"])
    assert pca.batch_scores(df.limit(0), 3).count() == 0


def error(x, label):
    return sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))


def test_kmeans_is_as_good_as_the_plain_one(cells):
    x, df = cells
    got = labels(kmeans.kmeans(df, {"a": 4, "b": 3}, starts=8))
    for b, k in (("a", 4), ("b", 3)):
        at = [i for i in range(150) if (i % 3 > 0) == (b == "a")]
        mine = np.array([got[i] for i in at])
        assert set(mine) == set(range(1, k + 1)) and list(dict.fromkeys(mine.tolist())) == list(range(1, k + 1))
        assert error(x[at], mine) <= error(x[at], cluster.lloyd(x[at], k)) * (1 + 1e-9)
    assert got == labels(kmeans.kmeans(df.repartition(5), {"a": 4, "b": 3}, starts=8))


def test_kmeans_of_copies_and_single_clusters(spark):
    x = np.array([[0.0, 0]] * 40 + [[1.0, 1]] * 3 + [[5.0, 5]])
    got = labels(kmeans.kmeans(frame(spark, x, ["a"] * 44), {"a": 9}, starts=3))
    assert [got[i] for i in (0, 39, 40, 42, 43)] == [1, 1, 2, 2, 3]
    assert set(labels(kmeans.kmeans(frame(spark, x, ["a"] * 22 + ["b"] * 22), {"a": 1, "b": 1})).values()) == {1}
    assert kmeans.kmeans(frame(spark, x, ["a"] * 44).limit(0), {"a": 2}).count() == 0


def near_plain(x, batch, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        out[i] = [j for j in np.lexsort((np.arange(len(x)), d)).tolist() if j != i and batch[j] == batch[i]][:k]
    return out


def test_all_pairs_are_exact(cells):
    x, df = cells
    batch = [bool(i % 3) for i in range(150)]
    for block in (16, 1024):
        got = {r["cell_id"]: r["near"] for r in neighbours.merged(neighbours.all_pairs(df, 7, block), 7).collect()}
        assert got == near_plain(x, batch, 7)


def test_forest_finds_most_neighbours(spark):
    x = np.random.default_rng(8).normal(size=(3000, 10))
    df = frame(spark, x, ["a"] * 3000)
    got = {r["cell_id"]: r["near"] for r in neighbours.nearest_cells(df, 10, "approximate").collect()}
    want = {r["cell_id"]: r["near"] for r in neighbours.nearest_cells(df, 10).collect()}
    assert np.mean([len(set(got[i]) & set(want[i])) for i in want]) / 10 >= 0.95


def test_leaves_of_copies_are_split(spark):
    x = np.r_[np.zeros((700, 3)), np.random.default_rng(3).normal(size=(200, 3))]
    df = frame(spark, x, ["a"] * 900)
    got = neighbours.nearest_cells(df, 4, "approximate", trees=4, leaf=40).collect()
    assert len(got) == 900 and all(len(r["near"]) == 4 for r in got)
    assert all(j < 700 for r in got if r["cell_id"] < 700 for j in r["near"])


def graph_plain(near, k):
    holders = defaultdict(list)
    for i, some in near.items():
        holders[i].append((i, 0))
        for r, j in enumerate(some, 1):
            holders[j].append((i, r))
    out = {}
    for some in holders.values():
        for i, r in some:
            for j, s in some:
                if i < j:
                    out[i, j] = max(out.get((i, j), 1e-6), k - (r + s) / 2)
    return out


def modularity_plain(weight, label):
    m, inside, degree = sum(weight.values()), 0.0, defaultdict(float)
    for (i, j), w in weight.items():
        inside += w * (label[i] == label[j])
        degree[label[i]] += w
        degree[label[j]] += w
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


@pytest.mark.parametrize("local", [0, 200_000])
def test_communities_are_as_good_as_the_plain_ones(spark, monkeypatch, local):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6, 8)) * 1.5, 40, 0) + rng.normal(size=(240, 8))
    df = frame(spark, x, ["a" if i % 40 < 25 else "b" for i in range(240)])
    near = neighbours.nearest_cells(df, 8)
    monkeypatch.setattr(communities, "HOLDERS", 7)
    edges = communities.shared_edges(near, 8).cache()
    plain = graph_plain({r["cell_id"]: r["near"] for r in near.collect()}, 8)
    assert {(r["i"], r["j"]): r["w"] for r in edges.collect()} == plain
    got = communities.communities(edges, df, local)
    mine, score = labels(got), communities.modularity(edges, got)
    assert len(mine) == 240
    for b in "ab":
        names = [i for i in range(240) if (i % 40 < 25) == (b == "a")]
        weight = {e: w for e, w in plain.items() if e[0] in set(names)}
        place = {v: n for n, v in enumerate(names)}
        label = communities.louvain(len(names), {(place[i], place[j]): w for (i, j), w in weight.items()})
        want = modularity_plain(weight, dict(zip(names, label, strict=True)))
        assert abs(score[b] - modularity_plain(weight, mine)) < 1e-9
        assert score[b] >= want - (0.02 if local == 0 else 0.005)
        assert list(dict.fromkeys(mine[i] for i in names)) == list(range(1, len({mine[i] for i in names}) + 1))


def test_louvain_counts_weight_within_nodes():
    weight = {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 1.0, (3, 4): 1.0, (4, 5): 1.0, (3, 5): 1.0, (2, 3): 0.5}
    whole = communities.louvain(6, weight)
    assert whole == [1, 1, 1, 2, 2, 2]
    assert communities.louvain(2, {(0, 1): 0.5}, {0: 3.0, 1: 3.0}) == [1, 2]
    assert communities.louvain(2, {(0, 1): 0.5}) == [1, 1]


def test_cells_without_edges(spark):
    df = frame(spark, np.array([[0.0], [1.0], [9.0]]), ["a", "a", "b"])
    assert labels(cluster.cluster_batches(df, None, 2)) == {0: 1, 1: 1, 2: 1}
