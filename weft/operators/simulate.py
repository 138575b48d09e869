"""Poisson test data: Y = X beta + W alpha + noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def simulate(spark: SparkSession, cells: int = 100, genes: int = 500, controls: int = 250, types: int = 3, batches: int = 2, k: int = 20, lam: float = 0.1, seed: int = 1) -> DataFrame:
    """(cell_id, values, cell_type, batch): types and batches dealt in turn; the first `controls` genes carry no biology.

    Every cell draws from its own stream of random numbers, so partitions don't matter.
    """

    def rows(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        beta, alpha = rng.poisson(lam, (types, genes)).astype(float), rng.poisson(lam, (k, genes)).astype(float)
        beta[:, :controls] = 0
        for rb in batches_:
            ids = rb.column(0).to_numpy()
            out = []
            for i in ids:
                own = np.random.default_rng([seed, int(i)])
                w = own.poisson(lam, k).astype(float)
                w[0] = i % batches + 1
                out.append(beta[i % types] + w @ alpha + own.poisson(lam, genes))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.list_(pa.float64())), pa.array([f"type_{i % types + 1}" for i in ids]), pa.array([f"batch_{i % batches + 1}" for i in ids])], ["cell_id", "values", "cell_type", "batch"])

    return spark.range(cells).withColumnRenamed("id", "cell_id").mapInArrow(rows, "cell_id long, values array<double>, cell_type string, batch string")
