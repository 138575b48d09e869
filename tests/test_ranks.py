"""Ranks, numbers and medians over ranges against plain versions, with one group that holds all cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import medians, stats


@pytest.fixture(scope="module")
def cells(spark):
    """One type with nearly all cells, a value that a third of them share, and a type of one cell."""
    rng = np.random.default_rng(6)
    v = np.where(np.arange(400) % 3 == 0, 2.5, rng.normal(size=400).round(1))
    rows = [(i, float(x), "t" if i else "alone") for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "cell_id long, v double, kind string").repartition(4).cache()


def test_average_ranks_over_ranges(spark, cells):
    v, df = cells
    small = df.withColumn("cell_id", F.col("cell_id"))
    got = {r["cell_id"]: r for r in stats.average_ranks(small, ["kind"], "v", least="lo", most="hi").collect()}
    some = v[1:]
    for i in range(1, 400):
        assert got[i]["_rank"] == (some < v[i]).sum() + ((some == v[i]).sum() + 1) / 2 and got[i]["_total"] == 399
    assert got[0]["_rank"] == 1 and got[0]["_total"] == 1 and len(got) == 400
    ranks = [got[i]["_rank"] for i in range(1, 400)]
    assert (got[5]["lo"], got[5]["hi"]) == (min(ranks), max(ranks))


def test_row_numbers_are_a_permutation(cells):
    _, df = cells
    got = stats.row_numbers(df, ["kind"], ["v", "cell_id"], "n", "all").orderBy("kind", "n").collect()
    some = [r for r in got if r["kind"] == "t"]
    assert [r["n"] for r in some] == list(range(1, 400)) and [(r["v"], r["cell_id"]) for r in some] == sorted((r["v"], r["cell_id"]) for r in some)
    assert stats.row_numbers(df.limit(0), ["kind"], ["v", "cell_id"], "n", "all").count() == 0


def test_folds_and_bins_of_one_group(cells):
    _, df = cells
    fold = [r["count"] for r in stats.folds(df, "kind", 7).where("kind = 't'").groupBy("fold").count().collect()]
    assert len(fold) == 7 and max(fold) - min(fold) <= 1
    bins = stats.equal_width_bins(df, "v", "kind", 5).collect()
    assert {r["bin"] for r in bins if r["kind"] == "t"} <= set(range(1, 6)) and [r["bin"] for r in bins if r["kind"] == "alone"] == [1]
    coded = stats.codes(df, "kind", "v", "c").where("kind = 't'").select("v", "c").distinct().orderBy("v").collect()
    assert [r["c"] for r in coded] == list(range(1, len(coded) + 1))


@pytest.mark.parametrize("narrow", [4096, 1])
@pytest.mark.parametrize("fetched", [0, 300, 1 << 20])
def test_medians_are_exact(spark, monkeypatch, fetched, narrow):
    monkeypatch.setattr(medians, "NARROW", narrow)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(101, 3)) * np.array([1e-8, 1, 1e9])
    x[::4, 1], x[5:30, 0], x[7, 2] = -0.0, 0.0, -1e300
    rows = [(i, [float(v) for v in r], i % 2, "a") for i, r in enumerate(x)] + [(200, [1.0, -2.0, 3.0], 5, "b")]
    df = spark.createDataFrame(rows, "cell_id long, values array<double>, k int, b string").repartition(3)
    got = medians.group_medians(df, "k", "b", fetched=fetched)
    assert got.keys() == {(0, "a"), (1, "a"), (5, "b")}
    for k in (0, 1):
        assert np.array_equal(got[k, "a"], np.median(x[k::2], 0))
    assert got[5, "b"].tolist() == [1, -2, 3] and medians.group_medians(df.limit(0), "k") == {}


def test_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -1e-320, 0.0, 1e-320, 2.0, np.inf])
    u = medians.ordered(x)
    assert (np.diff(u.astype(object)) > 0).all() and np.array_equal(medians.doubles(u), x) and medians.ordered(np.array([-0.0]))[0] == u[4]
