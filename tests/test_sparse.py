"""Sparse cells against the dense forms, and Lanczos against the exact solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import bulk, linear, sparse
from weft.sources import views as V

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    """120 cells of 30 genes, two thirds of them 0, one cell all 0."""
    rng = np.random.default_rng(2)
    x = np.maximum(rng.normal(size=(120, 30)) * 2 - 0.8 + (np.arange(120) % 2)[:, None] * rng.uniform(0, 1, 30), 0)
    x[7] = 0
    rows = [(i, [float(v) for v in r], f"b{i % 2}", f"t{i // 40}", "xy"[i // 20 % 2]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "cell_id long, values array<double>, batch string, cell_type string, condition string").repartition(3).cache()
    return x, df


CTL = np.arange(30) < 20


def values(df):
    return np.array([r["values"] for r in df.orderBy("cell_id").collect()])


def test_sparse_rows_are_the_cells(spark, cells):
    x, df = cells
    rows = sparse.from_dense(df).orderBy("cell_id").collect()
    for r, v in zip(rows, x, strict=True):
        assert r["pos"] == np.flatnonzero(v).tolist() and np.allclose(r["val"], v[v != 0])
    genes = spark.range(30).select(F.col("id").cast("int").alias("gene_id"), (29 - F.col("id")).cast("int").alias("pos"))
    long = linear.long(df, "batch")
    got = {r["cell_id"]: (r["pos"], r["val"]) for r in sparse.sparse_rows(long, genes, "batch").collect()}
    assert 7 not in got and len(got) == 119
    back = x[3][::-1]
    assert got[3][0] == np.flatnonzero(back).tolist() and np.allclose(got[3][1], back[back != 0])


def test_gram_and_its_products(cells, monkeypatch):
    x, df = cells
    want = linear.residual_gram(df, "cell_type")
    rows = sparse.signed(sparse.from_dense(df), "cell_type")
    q = np.random.default_rng(1).normal(size=(30, 3))
    for pairs in (50, 2 << 20):
        monkeypatch.setattr(sparse, "PAIRS", pairs)
        assert np.allclose(sparse.gram(rows, 30), want, atol=1e-9)
    assert np.allclose(sparse.gram_times(rows, q), want @ q, atol=1e-9)
    mean, sd = sparse.scale(sparse.from_dense(df), 30, "batch")
    wants = linear.scale(df, "batch")
    assert np.allclose(mean, wants[0], atol=1e-12) and np.allclose(sd, wants[1], atol=1e-12)


@pytest.mark.parametrize("solver", ["exact", "lanczos"])
def test_sparse_merge_equals_dense(cells, solver):
    x, df = cells
    some = df.where("cell_id <> 7")
    want = linear.adjust_scaled(some.withColumn("replicate", F.col("cell_type")), "replicate", "batch", CTL, [3])
    made = sparse.merge_sparse(sparse.from_dense(df), 30, CTL, 3, solver=solver)
    assert np.allclose(values(made.blocks()), values(want.blocks), atol=1e-8)
    keep = np.arange(30) % 7 == 2
    assert np.allclose(values(made.blocks(keep)), values(want.blocks)[:, keep], atol=1e-8)
    assert {len(r["w"]) for r in made.rows.collect()} == {3}


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("condition", [False, True])
def test_sparse_bulk_merge_equals_dense(cells, cosine, condition):
    _, df = cells
    df = df if condition else df.drop("condition")
    want = bulk.merge_bulk(df, CTL, 2, k_bulk=4, cosine=cosine, chosen="all")
    made = sparse.merge_bulk_sparse(sparse.from_dense(df), 30, CTL, 2, k_bulk=4, cosine=cosine)
    assert np.allclose(values(made.blocks()), values(want.blocks), atol=1e-8)


def test_no_factors_and_bad_controls(spark, cells):
    x, df = cells
    alone = sparse.from_dense(df).withColumn("own", F.col("cell_id").cast("string"))
    made = sparse.merge_sparse(alone, 30, CTL, 3, replicate="own")
    assert np.allclose(values(made.blocks()), x[np.arange(120) != 7])
    for bad in (np.zeros(30, bool), np.ones(29, bool)):
        with pytest.raises(ValueError):
            sparse.merge_sparse(alone, 30, bad)
    with pytest.raises(ValueError):
        sparse.fit(alone, 30, "cell_type", CTL, solver="other")


def counted(a):
    calls = []

    def apply(q):
        calls.append(q.shape[1])
        return a @ q

    return apply, calls


def test_lanczos_needs_fewer_passes_than_iteration():
    rng = np.random.default_rng(4)
    for n, rank in ((300, 10), (64, 20), (12, 12), (40, 1)):
        x = rng.normal(size=(500, n)) * np.r_[np.linspace(9, 3, min(5, n)), np.ones(n - min(5, n))]
        a = x.T @ x
        quick, widths = counted(a)
        value, vector, passes = linear.lanczos(quick, n, rank)
        want, exact = np.linalg.eigh(a)
        assert np.allclose(np.sqrt(value), np.sqrt(want[::-1][:rank]), rtol=1e-6)
        assert np.allclose(vector.T @ vector, np.eye(rank), atol=1e-9)
        assert np.allclose(a @ vector, vector * value, atol=2e-6 * want[-1])
        apply, calls = counted(a)
        linear.leading(apply, n, rank, False)
        assert sum(widths) <= sum(calls) and (n < 100 or 2 * sum(widths) < sum(calls))


def test_lanczos_of_few_directions():
    x = np.random.default_rng(5).normal(size=(3, 50))
    a = x.T @ x
    value, vector, _ = linear.lanczos(lambda q: a @ q, 50, 6)
    assert np.allclose(value[:3], np.linalg.eigvalsh(a)[::-1][:3]) and np.abs(value[3:]).max() < 1e-9 * value[0]
    assert np.allclose(linear.lanczos(lambda q: 0 * q, 9, 2)[0], 0)


def test_lanczos_on_a_table(spark):
    df = V.blocks(spark, DIR)
    exact = linear.fit(df, "cell_type", np.arange(64) < 32, rank=20)
    quick = linear.fit(df, "cell_type", np.arange(64) < 32, rank=20, solver="lanczos")
    size = lambda a: np.sqrt((a**2).sum(1))
    assert np.allclose(size(exact), size(quick), rtol=1e-6)
    assert np.allclose(np.abs((exact * quick).sum(1)), size(exact) ** 2, rtol=1e-5)


def test_joins_of_lines_keep_to_their_partitions(spark, monkeypatch):
    want = V.counts(spark, DIR, True)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert V.parts_of(spark.range(lines)) is None  # a core's share is small
    monkeypatch.setattr(V, "ROWS", 300)
    got = V.counts(spark, DIR, True)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0
    assert got.rdd.getNumPartitions() == -(-lines // 300) > 4
    assert V.supplier_counts(spark, DIR).rdd.getNumPartitions() >= -(-lines // 300)


def test_gathered_counts_are_the_sparse_rows(spark, monkeypatch):
    from weft.plans import catalogue

    lg = V.counts(spark, DIR, True).withColumn("value", F.log2(F.col("value") + 1)).join(V.customers(spark, DIR), "cell_id")
    monkeypatch.setattr(V, "ROWS", 300)
    rows, names = catalogue._sparse_counts(spark, DIR)
    assert names == sorted(r[0] for r in lg.select("gene_id").distinct().collect())
    genes = spark.createDataFrame(list(enumerate(names)), "pos int, gene_id string")
    want = sparse.sparse_rows(lg, genes, "batch", "cell_type")
    assert rows.columns == want.columns and rows.exceptAll(want).isEmpty() and rows.count() == want.count() > 0


def test_positions_close_up_where_genes_were_never_bought(spark, tmp_path):
    from weft.plans import catalogue

    for t in ("customer", "orders", "lineitem", "part", "nation", "region"):
        df = spark.read.parquet(f"{DIR}/{t}.parquet")
        df = df.join(spark.read.parquet(f"{DIR}/part.parquet").where("p_brand like 'Brand#2%'").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select(df.columns) if t == "lineitem" else df
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    rows, names = catalogue._sparse_counts(spark, f"file://{tmp_path}")
    assert names and not any(n.startswith("Brand#2") for n in names)
    long = rows.select("cell_id", F.explode(F.arrays_zip("pos", "val")).alias("x")).select("cell_id", F.col("x.pos").alias("pos"), F.col("x.val").alias("v"))
    named = long.join(spark.createDataFrame(list(enumerate(names)), "pos int, gene_id string"), "pos").select("cell_id", "gene_id", F.round("v", 9))
    want = V.counts(spark, f"file://{tmp_path}", True).select("cell_id", "gene_id", F.round(F.log2(F.col("value") + 1), 9))
    assert named.exceptAll(want).isEmpty() and named.count() == want.count() > 0
