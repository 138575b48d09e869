"""Pseudo-bulk aggregates, and merging through them: the fit sees bulk rows, the adjustment every cell."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import linear
from .cluster import cluster_batches
from .features import top_by_trend
from .matching import match_clusters, match_labels
from .stats import codes, equal_width_bins, folds
from .validate import check_blocks

BUILDERS = ("mean", "divide", "pool_divide")


def sample_column(cells: DataFrame) -> DataFrame:
    """cells with sample (batch, or batch_condition) and its number in order."""
    label = F.concat_ws("_", "batch", "condition") if "condition" in cells.columns else F.col("batch").cast("string")
    named = cells.withColumn("sample", label)
    numbers = named.select("sample").distinct().select("sample", F.dense_rank().over(Window.orderBy("sample")).alias("sample_no"))
    return named.join(numbers, "sample")


def mean_bulk(expr: DataFrame, cells: DataFrame, k: int = 30, seed: int = 1) -> DataFrame:
    """(sample, cluster, fold, n_cells, gene_id, value): folds over each sample, then means of each cluster in a fold.

    cells(cell_id, sample, cluster). Zeros left out of expr count.
    """
    dealt = folds(cells.select("cell_id", "sample", "cluster"), "sample", k, seed)
    group = ["sample", "cluster", "fold"]
    size = dealt.groupBy(*group).agg(F.count("*").alias("n_cells"))
    sums = expr.select("cell_id", "gene_id", "value").join(dealt, "cell_id").groupBy(*group, "gene_id").agg(F.sum("value").alias("s"))
    return sums.join(size, group).select(*group, "n_cells", "gene_id", (F.col("s") / F.col("n_cells")).alias("value"))


def divided_bulk(counts: DataFrame, cells: DataFrame, k: int = 30, pool: bool = False, seed: int = 1) -> DataFrame:
    """As mean_bulk, from counts: folds (pool: bins of library size) within each cluster, sums thinned binomially by the
    fold's cells and normalised; clusters of k cells at most keep their cells (pool: normalised)."""
    n = cells.groupBy("sample", "cluster").agg(F.count("*").alias("cluster_n"))
    total = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    known = cells.select("cell_id", "sample", "cluster").join(n, ["sample", "cluster"]).join(total, "cell_id").withColumn("unit", F.concat_ws("\t", "sample", "cluster"))
    large, small = known.where(F.col("cluster_n") > k), known.where(F.col("cluster_n") <= k)
    dealt = equal_width_bins(large, "total", "unit", k).withColumnRenamed("bin", "fold") if pool else folds(large, "unit", k, seed)
    sums = counts.join(dealt, "cell_id").groupBy("sample", "cluster", "fold", "gene_id").agg(F.sum("value").alias("s"), F.countDistinct("cell_id").alias("holders"))
    sums = sums.drop("holders").join(dealt.groupBy("sample", "cluster", "fold").agg(F.count("*").alias("n_cells")), ["sample", "cluster", "fold"])

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by("gene_id")
        key = "\t".join(str(table[c][0].as_py()) for c in ("sample", "cluster", "fold"))
        rng = np.random.default_rng(zlib.crc32(f"{key}\t{seed}".encode()))
        value = rng.binomial(np.rint(table["s"].to_numpy()).astype(np.int64), 1 / table["n_cells"].to_numpy())
        return table.select(["sample", "cluster", "fold", "n_cells", "gene_id"]).append_column("value", pa.array(value.astype(float)))

    kind = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join(f"{c} {kind[c]}" for c in ("sample", "cluster", "fold", "n_cells", "gene_id")) + ", value double"
    thinned = _normalised(sums.groupBy("sample", "cluster", "fold").applyInArrow(thin, schema))
    own = counts.join(small, "cell_id").select("sample", "cluster", (-F.col("cell_id") - 1).cast("int").alias("fold"), F.lit(1).cast(kind["n_cells"]).alias("n_cells"), "gene_id", F.col("value").cast("double").alias("value"))
    return thinned.unionByName(_normalised(own) if pool else own)


def _normalised(bulk: DataFrame) -> DataFrame:
    group = ["sample", "cluster", "fold"]
    total = bulk.groupBy(*group).agg(F.sum("value").alias("t"))
    mean = total.groupBy("sample").agg(F.avg("t").alias("mt"))
    return bulk.join(total, group).join(mean, "sample").withColumn("value", F.when(F.col("t") > 0, F.log2(F.col("value") / (F.col("t") / F.col("mt")) + 1)).otherwise(0.0)).drop("t", "mt")


@dataclass
class BulkMerge:
    """Adjusted blocks (None if only the factors were asked for), bulk replicates, factors, gene means, controls, genes matched on."""

    blocks: DataFrame | None
    replicates: DataFrame
    alpha: np.ndarray
    mean: np.ndarray
    controls: np.ndarray
    chosen: list[int] | None = None


def unit_length(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)


def bulk_factors(rows: DataFrame, controls: np.ndarray, k: int, small, solver: str = "exact") -> tuple[np.ndarray, DataFrame]:
    """Factors of pseudo-bulk rows(sample, cluster, fold[, condition], values) and their replicates, matched within a condition; small picks genes."""
    fine = lambda x: F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)
    condition = F.col("condition") if "condition" in rows.columns else F.lit("")
    rows = rows.select(F.concat_ws("\t", "sample", "cluster", "fold").alias("cell_id"), F.col("sample").alias("batch"), "cluster", condition.alias("condition"), F.transform("values", fine).alias("values"))
    rows = materialize(rows, "bulk")
    labels = None
    for part in sorted(r[0] for r in rows.select("condition").distinct().collect()):
        here = rows.where(F.col("condition") == part)
        matched = match_clusters(small(here), "cor") if here.select("batch").distinct().count() > 1 else None
        named = match_labels(here.select("cell_id", "batch", "cluster", F.lit(0.0).alias("dist_prop")), matched).select("cell_id", F.concat(F.lit(part), F.lit("|" if part else ""), "replicate").alias("replicate"))
        labels = named if labels is None else labels.union(named)
    labels = materialize(labels, "bulk-labels")
    return linear.fit(rows.select("cell_id", "values").join(labels, "cell_id"), "replicate", controls, k, solver, k), labels


def merge_bulk(blocks: DataFrame, controls: np.ndarray, k: int = 20, cell_type: str | None = "cell_type", k_bulk: int = 30, k_neighbours: int = 10, cosine: bool = True, return_matrix: bool = True, keep: np.ndarray | None = None, builder: str = "mean", counts: DataFrame | None = None, seed: int = 1, chosen: list[int] | str = "trend", top: int = 2000, solver: str = "exact", neighbours: str = "exact") -> BulkMerge:
    """Merging through pseudo-bulk. blocks(cell_id, batch[, condition], values[, cell_type]).

    Cells are grouped within their sample, aggregated, matched across samples (within a condition), and the factors of
    the bulk rows adjust every cell. Cosine normalisation comes after grouping. chosen: positions of the genes that
    grouping and matching look at; "trend" takes the `top` ones beyond the mean-variance trend, "all" every gene. Cells
    that are zero throughout are dropped.
    """
    if builder not in BUILDERS:
        raise ValueError(f"builder is one of {BUILDERS}")
    if builder != "mean" and counts is None:
        raise ValueError("this builder needs counts")
    given = chosen if not isinstance(chosen, str) else None
    check_blocks(blocks, controls, cell_type, "condition" in blocks.columns, given, keep)
    blocks = blocks.where(F.exists("values", lambda x: x != 0))
    if chosen == "trend":
        given = top_by_trend(blocks, top) or None
    small = (lambda df: linear.transform(df, {"values": lambda y: y[:, np.asarray(given)]})) if given is not None else (lambda df: df)
    cells = sample_column(blocks.drop("values"))
    if cell_type:
        cells = codes(cells, "sample", cell_type, "cluster")
    else:
        cells = cells.join(cluster_batches(small(blocks), None, k_neighbours, neighbours=neighbours).select("cell_id", "cluster"), "cell_id")
    prep = unit_length if cosine else None
    extra = ["condition"] if "condition" in cells.columns else []
    if builder == "mean":
        dealt = materialize(folds(cells.select("cell_id", "sample", "cluster", *extra), "sample", k_bulk, seed), "folds")
        sums = linear.sum_arrays(blocks.select("cell_id", "values").join(dealt, "cell_id"), "sample", "cluster", "fold", *extra, prep=prep)
        rows = sums.withColumn("values", F.transform("values", lambda x: x / F.col("n")))
    else:
        bulk = divided_bulk(counts, cells, k_bulk, builder == "pool_divide", seed)
        rows = linear.arrays(bulk.withColumn("cell_id", F.concat_ws("\t", "sample", "cluster", "fold")), list(range(len(controls))), "sample", "cluster", "fold").drop("cell_id")
        if extra:
            rows = rows.join(cells.select("sample", "condition").distinct(), "sample")
    alpha, labels = bulk_factors(rows, controls, k, small, solver)
    mean = linear.means(blocks, prep)
    made = None
    if return_matrix:
        step = linear.adjusted(linear.projector(alpha, controls, k), controls, mean, keep)
        made = linear.transform(blocks, {"values": (lambda y: step(unit_length(y))) if cosine else step})
    return BulkMerge(made, labels, alpha, mean, controls, given)


def apply_factors(blocks: DataFrame, merged: BulkMerge, k: int = 20, keep: np.ndarray | None = None) -> DataFrame:
    """The adjustment by stored factors of any cells (a part, or a stream)."""
    return linear.adjust(blocks, linear.projector(merged.alpha, merged.controls, k), merged.controls, merged.mean, keep)
