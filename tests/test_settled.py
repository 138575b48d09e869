"""Streams of tables in part files; Lanczos as exact as the decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import linear
from weft.plans import catalogue
from weft.streaming import apply

DIR = "/root/testdata/sf0.001"


def test_stream_reads_part_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    whole = spark.read.parquet(f"{DIR}/embeddings.parquet")
    whole.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    whole.limit(5).write.parquet(f"{path}/other.parquet")
    want = catalogue.queries()["stream_factors_given"](spark, DIR)
    got = catalogue.queries()["stream_factors_given"](spark, path)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    both = apply.cell_stream(spark, path, "vec_id long, embedding array<float>, label int")
    assert apply.run_once(both.select(F.col("vec_id")), f"{path}/out").count() == whole.count() + 5


@pytest.mark.parametrize("seed", range(3))
def test_lanczos_vectors_are_exact(seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    value = np.r_[1.0, 0.9, 0.8 * 0.985 ** np.arange(148)]
    g = (q * value) @ q.T
    found = linear.lanczos(lambda x: g @ x, 150, 2, settled=linear.FIT_SETTLED)[1]
    assert np.abs(1 - np.abs((found * q[:, :2]).sum(0))).max() < 1e-14
    assert max(np.linalg.norm(found[:, i] - np.sign(found[:, i] @ q[:, i]) * q[:, i]) for i in (0, 1)) < 5e-12
