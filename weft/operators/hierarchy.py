"""Merging in levels: each level merges its data sets from the newest values of their cells."""

from __future__ import annotations

from pathlib import PurePosixPath
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from .bulk import merge_bulk
from .validate import check_levels


def newest(raw: DataFrame, *levels: DataFrame) -> DataFrame:
    """raw(cell_id, values, ...) with the values of the last level that has the cell."""
    out = raw.withColumnRenamed("values", "_v0")
    for i, level in enumerate(levels, 1):
        out = out.join(level.select("cell_id", F.col("values").alias(f"_v{i}")), "cell_id", "left")
    order = [f"_v{i}" for i in range(len(levels), -1, -1)]
    return out.withColumn("values", F.coalesce(*order)).drop(*order)


def uncovered(raw: DataFrame, level: DataFrame) -> DataFrame:
    return raw.join(level, "cell_id", "left_anti")


def merge_levels(blocks: DataFrame, hierarchy: DataFrame, controls: np.ndarray, ks: list[int], folder: str | None = None, **options) -> list[DataFrame]:
    """The output of each level. hierarchy(level, dataset, cell_id, batch); ks is recycled. Levels are cut by written tables."""
    check_levels(hierarchy)
    empty = blocks.where(~F.exists("values", lambda x: x != 0)).count()
    if empty:
        raise ValueError(f"{empty} cells are zero throughout; remove them before merging in levels")
    spark = blocks.sparkSession
    home = folder or scratch_dir(spark)
    plan = sorted(tuple(r) for r in hierarchy.select("level", "dataset").distinct().collect())
    numbers = sorted({level for level, _ in plan})
    out: list[DataFrame] = []
    for i, level in enumerate(numbers):
        now = newest(blocks, *out)
        made = None
        for dataset in [d for n, d in plan if n == level]:
            mine = hierarchy.where((F.col("level") == level) & (F.col("dataset") == dataset)).select("cell_id", "batch")
            genes = options if i == 0 else options | {"chosen": "all"}  # values of higher levels are no expressions any more
            part = merge_bulk(now.drop("batch").join(mine, "cell_id"), controls, ks[i % len(ks)], **genes).blocks.select("cell_id", "values")
            made = part if made is None else made.union(part)
        path = f"{str(home).rstrip('/')}/{PurePosixPath('weft') / 'levels'}-{uuid4().hex}"
        made.write.parquet(path)
        out.append(spark.read.schema(made.schema).parquet(path))
    return out
