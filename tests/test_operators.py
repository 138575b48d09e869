"""Properties of the operators on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import bulk, cluster, features, filters, hierarchy, linear, matching, merge, replicate, simulate, stability, validate


def frame(spark, x, batch, kind=None):
    kind = kind or ["t"] * len(x)
    return spark.createDataFrame([(i, [float(v) for v in row], b, t) for i, (row, b, t) in enumerate(zip(x, batch, kind, strict=True))], "cell_id long, values array<double>, batch string, cell_type string")


def values(df):
    return np.array([r["values"] for r in df.orderBy("cell_id").collect()])


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 12)) + np.repeat(rng.normal(size=(3, 12)) * 3, 20, 0) + (np.arange(60) % 2)[:, None] * rng.normal(size=12)
    return x, frame(spark, x, [f"b{i % 2}" for i in range(60)], [f"t{i // 20}" for i in range(60)]).cache()


CTL = np.arange(12) < 8


def test_fit_equals_singular_values_of_residual(cells):
    x, df = cells
    alpha = linear.fit(df, "cell_type", CTL, 5)
    resid = x - np.repeat([x[i : i + 20].mean(0) for i in (0, 20, 40)], 20, 0)
    u, d, v = np.linalg.svd(resid, full_matrices=False)
    assert np.allclose(np.abs(alpha), np.abs(d[:5, None] * v[:5]), atol=1e-8)
    want = x - x[:, CTL] @ linear.projector((u[:, :3].T @ x), CTL, 3)
    assert np.allclose(values(linear.adjust(df, linear.projector(alpha, CTL, 3), CTL)), want, atol=1e-8)


def test_no_factor_changes_nothing(cells):
    x, df = cells
    assert np.allclose(values(merge.merge_cells(df, CTL, 0).blocks), x)
    alone = df.withColumn("own", F.col("cell_id").cast("string"))
    assert len(linear.fit(alone, "own", CTL)) == 0


def test_order_and_partitions_do_not_matter(cells):
    _, df = cells
    a = values(merge.merge_cells(df.repartition(1), CTL, 2).blocks)
    b = values(merge.merge_cells(df.orderBy(F.desc("cell_id")).repartition(7), CTL, 2).blocks)
    assert np.allclose(a, b, atol=1e-8)


def test_batches_come_together(spark):
    df = simulate.simulate(spark, cells=120, genes=60, controls=30, k=2, lam=2.0)
    out = merge.merge_cells(df, np.arange(60) < 30, 2).blocks
    assert linear.silhouette(out, "batch") < linear.silhouette(df, "batch")


def test_parts_adjust_like_the_whole(cells):
    _, df = cells
    made = bulk.merge_bulk(df, CTL, 3, k_bulk=4)
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v))
    unit = df.withColumn("l", length).withColumn("values", F.transform("values", lambda v: v / F.col("l"))).drop("l")
    parts = bulk.apply_factors(unit.where("cell_id < 25"), made, 3).union(bulk.apply_factors(unit.where("cell_id >= 25"), made, 3))
    assert np.allclose(values(made.blocks), values(parts), atol=1e-8)


def test_one_level_is_a_plain_merge(spark, cells, tmp_path):
    _, df = cells
    plan = df.select(F.lit(1).alias("level"), F.lit(0).alias("dataset"), "cell_id", "batch")
    out = hierarchy.merge_levels(df, plan, CTL, [2], f"file://{tmp_path}")[-1]
    assert np.allclose(values(out), values(bulk.merge_bulk(df, CTL, 2).blocks), atol=1e-8)
    with pytest.raises(ValueError):
        validate.check_levels(plan.where("batch = 'b0'"))
    zero = df.withColumn("values", F.when(F.col("cell_id") == 4, F.array_repeat(F.lit(0.0), 12)).otherwise(F.col("values")))
    with pytest.raises(ValueError, match="zero"):
        hierarchy.merge_levels(zero, plan, CTL, [2], f"file://{tmp_path}")


def test_three_batches_of_one_cluster(spark):
    x = np.r_[np.eye(4)[[0] * 5], np.eye(4)[[2] * 5], np.eye(4)[[0] * 5]] + np.random.default_rng(1).normal(0, 0.01, (15, 4))
    df = frame(spark, x, ["1"] * 5 + ["2"] * 5 + ["3"] * 5).withColumn("cluster", F.lit(1))
    got = {r["batch"]: r["grp"] for r in matching.match_clusters(df, "cor").collect()}
    assert got == {"1": 1, "2": 2, "3": 1}
    assert matching.match_clusters(df.where("batch < '3'"), "cor") is None


def test_modularity_splits_a_chain_of_cliques():
    nodes = list("abcdef")
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    got = matching.communities(nodes, edges)
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(5) * 9, 12, 0) + rng.normal(0, 0.3, (60, 5))
    df = frame(spark, x, ["a"] * 60)
    for got in (cluster.cluster_batches(df, {"a": 5}), cluster.cluster_batches(df, None, 6)):
        label = [r["cluster"] for r in got.orderBy("cell_id").collect()]
        assert len(set(label)) == 5 and all(len(set(label[i : i + 12])) == 1 for i in range(0, 60, 12))


def test_replicate_routes(spark, cells):
    _, df = cells
    k = {"b0": 3, "b1": 3}
    for options in ({"cell_type": "cell_type"}, {"cell_type": "cell_type", "match": True}, {"k": k}, {"k": k, "cell_type": "cell_type", "known": df.where("cell_id < 5").select("cell_id")}, {"k": k, "wanted": df.select("cell_id", (F.col("cell_id") % 2).alias("wv")), "markers": [0, 1]}):
        got = replicate.find_replicates(df, **options)
        assert got.count() == got.select("cell_id").distinct().count() == 60
    whole = replicate.replicates_of(df, cell_type="cell_type", match=True)
    assert {(r["batch"], r["cluster"]) for r in whole.groups.collect()} == {(f"b{i}", f"t{j}") for i in range(2) for j in range(3)}
    assert whole.clusters.count() == whole.matrix().count() == 60 and whole.genes is None
    half = replicate.find_replicates(df, cell_type="cell_type", prop=0.5)
    assert half.where("replicate like 'cell:%'").count() == 30
    with pytest.raises(ValueError):
        replicate.find_replicates(df, cell_type="cell_type", match=True, known=df)
    with pytest.raises(ValueError):
        replicate.find_replicates(df)


def test_control_genes_alone(cells):
    x, df = cells
    got, _ = linear.control_only(df, CTL, 2)
    y = x - x.mean(0)
    w = np.linalg.svd(y[:, CTL], full_matrices=False)[0][:, :2]
    assert np.allclose(values(got), x - w @ (w.T @ y), atol=1e-6)
    with pytest.raises(ValueError):
        linear.control_only(df, CTL, 9)


def test_mixture_and_digamma():
    assert abs(stability.digamma(1.0) + 0.5772156649015329) < 1e-9
    assert abs(stability.inverse_digamma(stability.digamma(3.7)) - 3.7) < 1e-8
    rng = np.random.default_rng(4)
    got = stability.mixture(np.r_[rng.normal(8, 0.5, 600), rng.gamma(2, 0.5, 400)])
    assert abs(got["mu"] - 8) < 0.1 and abs(got["rho"] - 0.6) < 0.05
    assert stability.mixture(np.array([1.0, 0.0, 2.0])) is None
    some = np.log2(rng.poisson(6, 501) + 1.0)
    value, n = np.unique(some, return_counts=True)
    runs, single = stability.mixture(value, n), stability.mixture(some)
    assert all(abs(runs[k] - single[k]) < 1e-9 * max(1, abs(single[k])) for k in single)


def test_validation(spark):
    expr = spark.createDataFrame([(1, "g", 1.0), (2, "g", 2.0)], "cell_id long, gene_id string, value double")
    ok = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "cell_id long, batch string, cell_type string")
    validate.check(expr, ok)
    for bad in (ok.union(ok), ok.withColumn("batch", F.lit(None).cast("string")), ok.withColumn("cell_type", F.lit(None).cast("string")), ok.drop("batch")):
        with pytest.raises(ValueError):
            validate.check(expr, bad)
    with pytest.raises(ValueError):
        validate.check(expr.withColumn("value", F.lit(float("inf"))), ok)
    with pytest.raises(ValueError):
        validate.check(expr, ok, spark.createDataFrame([("x",)], "gene_id string"))
    with pytest.raises(ValueError):
        validate.check(expr, ok, ks=[1, 2], names=["a"])
    with pytest.raises(ValueError):
        filters.combine(expr, ok, "other")
    with pytest.raises(ValueError):
        stability.stable_genes(expr.union(spark.createDataFrame([(1, "h", 0.0)], expr.schema)), ok)


def test_solvers_agree(spark, monkeypatch):
    df = simulate.simulate(spark, cells=90, genes=150, controls=70, k=3, lam=1.0).withColumn("values", F.transform("values", lambda v: F.log2(v + 1)))
    ctl = np.arange(150) < 70
    want = linear.fit(df, "cell_type", ctl, rank=4)
    span = lambda a: a.T @ np.linalg.solve(a @ a.T, a)
    monkeypatch.setattr(linear, "MAX_GENES", 100)
    by_cells = linear.fit(df, "cell_type", ctl, rank=4)
    assert np.allclose(np.abs((by_cells * want).sum(1)), (want**2).sum(1), rtol=1e-6)
    monkeypatch.setattr(linear, "MAX_CELLS", 10)
    settled = linear.fit(df, "cell_type", ctl, rank=4)
    assert np.allclose(np.abs((settled * want).sum(1)), (want**2).sum(1), rtol=1e-4)
    quick = linear.fit(df, "cell_type", ctl, rank=4, solver="random")
    assert np.abs(span(quick[:1]) - span(want[:1])).max() < 0.02
    with pytest.raises(ValueError):
        linear.fit(df, "cell_type", ctl, solver="other")


def test_array_sums(spark):
    rows = [(i % 3 if i % 7 else None, [float(i), 1.0, -float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, values array<double>").repartition(5)
    got = {r["k"]: (r["n"], r["values"]) for r in linear.sum_arrays(df, "k").collect()}
    assert got == {k: (len(x), [sum(x), float(len(x)), -sum(x)]) for k in (None, 0, 1, 2) for x in [[r[1][0] for r in rows if r[0] == k]]}
    assert linear.sum_arrays(df).first()["n"] == 200 and linear.sum_arrays(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("metric", matching.METRICS)
def test_medians_by_bins_are_exact(spark, metric):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(size=(70, 5)), np.ones((20, 5)) + np.arange(5)]
    rows = [(i, [float(v) for v in r], "ab"[i % 2], i % 3 if i < 70 else 9) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "cell_id long, values array<double>, batch string, cluster int").repartition(3)
    key = lambda r: tuple(r)[:4]
    want = {key(r): r["dist"] for r in matching.median_distances(matching.pair_distances(df, metric)).collect()}
    for singly in (3, 20, 10**6):
        got = {key(r): r["dist"] for r in matching.median_between(df, metric, block=16, singly=singly).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_entry_checks_and_drops_zeros(spark, cells):
    x, df = cells
    wide = df.withColumn("values", F.concat("values", F.array(F.lit(0.0)))).unionByName(df.limit(1).withColumn("cell_id", F.lit(99).cast("long")).withColumn("values", F.array_repeat(F.lit(0.0), 13)))
    ctl = np.r_[CTL, True]
    made = merge.merge_cells(wide, ctl, [1, 2], names=["one", "two"])
    assert made.genes.tolist() == list(range(12)) and made.blocks.where("cell_id = 99").isEmpty() and set(made.scores) == {1, 2}
    assert np.allclose(values(made.blocks.withColumn("values", F.col("two"))), values(merge.merge_cells(df, CTL, 2).blocks))
    assert np.allclose(values(made.blocks), values(made.blocks.withColumn("values", F.col({1: "one", 2: "two"}[made.k]))))
    named = df.withColumnRenamed("values", "logs").withColumnRenamed("batch", "plate")
    assert np.allclose(values(merge.merge_cells(named, CTL, 2, value="logs", batch="plate").blocks), values(merge.merge_cells(df, CTL, 2).blocks))
    null = lambda c: df.withColumn(c, F.when(F.col("cell_id") != 3, F.col(c)))
    for bad in (df.union(df.limit(1)), null("batch"), null("cell_type"), null("cell_id"), null("values"), df.drop("batch"), df.drop("cell_type"), df.limit(0), df.withColumn("values", F.transform("values", lambda v: v * float("inf"))), df.withColumn("values", F.slice("values", 1, 5))):
        with pytest.raises(ValueError):
            merge.merge_cells(bad, CTL, 2)
        with pytest.raises(ValueError):
            bulk.merge_bulk(bad, CTL, 2)
    for options in ({"ks": [1, 2]}, {"ks": [1, 2], "names": ["one"]}, {"marker": []}, {"marker": [40]}):
        with pytest.raises(ValueError):
            merge.merge_cells(df, CTL, **({"ks": 2} | options))
    with pytest.raises(ValueError):
        merge.merge_cells(df, np.zeros(12, bool), 2)
    with pytest.raises(ValueError):
        bulk.merge_bulk(df, CTL, 2, keep=np.zeros(12, bool))
    assert merge.without_zeros(wide, genes=False)[0].count() == 60


def test_genes_for_matching(spark, cells):
    _, df = cells
    with pytest.raises(ValueError):
        features.union_of([]) or features.choose_genes(df.withColumn("values", F.array_repeat(F.lit(1.0), 12)))
    assert features.choose_genes(df, [4, 2], [[1]]) == [4, 2] and features.choose_genes(df, None, {"b0": [4, 2], "b1": [2, 7]}) == [4, 2, 7]
    rng = np.random.default_rng(5)
    mean = rng.uniform(8, 30, 300)
    x = rng.poisson(mean, (400, 300)).astype(float)
    x[:, :20] *= np.where(np.arange(400) // 2 % 4 == 0, 5, 0.585)[:, None]  # beyond the trend, of about the same mean logarithm
    noisy = frame(spark, x, [f"b{i % 2}" for i in range(400)])
    found = features.variable_positions(noisy)
    assert set(range(20)) <= set(found) and len(found) < 30
    logs = noisy.withColumn("values", F.transform("values", lambda v: F.log2(v + 1)))
    top = features.top_by_trend(logs, 20)
    assert len(set(top) & set(range(20))) >= 18
    long = linear.long(noisy, "batch").withColumn("gene_id", F.col("gene_id").cast("string"))
    assert sorted(map(int, features.variable_genes(long.drop("batch"), noisy.select("cell_id", "batch")))) == found
    a = merge.merge_cells(df, CTL, 2, k={"b0": 3, "b1": 3}, cell_type=None, marker=[0, 1, 2, 3, 4, 5])
    assert a.blocks.count() == 60 and bulk.merge_bulk(df, CTL, 2, chosen=[0, 1, 2, 3, 4]).chosen == [0, 1, 2, 3, 4]


def test_silhouettes_of_many_in_one_pass(cells):
    x, df = cells
    wide = df.withColumn("half", F.slice("values", 1, 5))
    got = linear.silhouettes(wide, ["cell_type", "batch"], ["values", "half"], block=16)
    few = linear.sampled_silhouettes(wide, ["cell_type", "batch"], ["values", "half"], sample=60)
    part = linear.sampled_silhouettes(wide, ["cell_type"], ["values"], sample=30)["values", "cell_type"]
    for array, y in (("values", x), ("half", x[:, :5])):
        d = np.sqrt(((y[:, None] - y) ** 2).sum(2))
        for label, names in (("cell_type", np.arange(60) // 20), ("batch", np.arange(60) % 2)):
            own = names[:, None] == names
            a = (d * own).sum(1) / (own.sum(1) - 1)
            b = np.min([np.where(names == c, np.inf, d[:, names == c].mean(1)) for c in set(names)], 0)
            want = ((b - a) / np.maximum(a, b)).mean()
            assert abs(got[array, label] - want) < 1e-9
            assert abs(few[array, label][0] - want) < 1e-9 and few[array, label][1] == 0
    assert 0 < part[1] and abs(part[0] - got["values", "cell_type"]) < 6 * part[1]
    assert linear.silhouette(df.where("cell_id = 1"), "batch") == 0


def test_chi_square_tail():
    assert abs(features.chi2_tail(15.507313, 8) - 0.05) < 1e-7 and abs(features.chi2_tail(3.0, 8) - 0.9343575) < 1e-6
    assert abs(features.chi2_tail(124.3421134, 100) - 0.05) < 1e-7 and features.chi2_tail(0, 3) == 1.0


def test_gene_covariates_and_design(spark, cells):
    x, df = cells
    eta = np.arange(12) % 5.0
    e = np.stack([np.ones(12), eta])
    ec = e[:, CTL]
    want = x - x[:, CTL] @ ec.T @ np.linalg.solve(ec @ ec.T, e)
    assert np.allclose(values(linear.regress_genes(df, eta, CTL)), want, atol=1e-9)
    got, _ = linear.control_only(df.withColumn("z", F.col("cell_id") % 3), CTL, 2, design=["z"], eta=eta)
    z = np.stack([np.arange(60) % 3, np.ones(60)], 1)
    y0 = want - z @ np.linalg.lstsq(z, want, rcond=None)[0]
    w = np.linalg.svd(y0[:, CTL], full_matrices=False)[0][:, :2]
    assert np.allclose(values(got), x - w @ (w.T @ y0), atol=1e-6)
    out = linear.adjust_scaled(df.withColumn("replicate", F.col("cell_type")), "replicate", "batch", CTL, [1], eta=eta)
    assert out.blocks.count() == 60 and np.isfinite(values(out.blocks)).all()


def test_tables_stack_by_position(spark, cells):
    _, df = cells
    got = filters.stack([df.where("cell_id < 9"), df.where("cell_id >= 9")])
    assert {(r["batch"], r["count"]) for r in got.groupBy("batch").count().collect()} == {("batch 1", 9), ("batch 2", 51)}
    assert {r["batch"] for r in filters.stack([df, df], ["x", "y"]).select("batch").distinct().collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        filters.stack([df], ["x", "y"])


def test_factors_on_a_stream(spark, cells, tmp_path):
    from weft.streaming import apply

    _, df = cells
    made = bulk.merge_bulk(df, CTL, 2, cosine=False, chosen="all")
    df.select("cell_id", "values").write.parquet(f"{tmp_path}/in")
    stream = apply.adjusted_stream(apply.cell_stream(spark, f"{tmp_path}/in", "cell_id long, values array<double>"), made, 2)
    assert np.allclose(values(apply.run_once(stream, str(tmp_path))), values(made.blocks), atol=1e-9)
