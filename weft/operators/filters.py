"""Filters over long expression tables. Zeros may be left out; cells without a row are all zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_zero(expr: DataFrame, genes: bool = True) -> DataFrame:
    """Drops cells (and genes) whose sum is 0; both sums are taken before either drop."""
    keep = expr.groupBy("cell_id").agg(F.sum("value").alias("s")).where("s <> 0").select("cell_id")
    out = expr.join(keep, "cell_id", "left_semi")
    if genes:
        out = out.join(expr.groupBy("gene_id").agg(F.sum("value").alias("s")).where("s <> 0").select("gene_id"), "gene_id", "left_semi")
    return out


def sparse(expr: DataFrame) -> DataFrame:
    return expr.where("value <> 0")


def finite(expr: DataFrame) -> DataFrame:
    """Infinite values become 0."""
    return expr.withColumn("value", F.when(F.abs("value") == float("inf"), 0.0).otherwise(F.col("value")))


def densify(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """All pairs of a cell and a gene, the missing ones as 0: genes are few and known, so they ride on each cell."""
    genes = expr.groupBy().agg(F.collect_set("gene_id").alias("genes"))
    grid = cells.select("cell_id").crossJoin(F.broadcast(genes)).select("cell_id", F.explode("genes").alias("gene_id"))
    return grid.join(expr, ["cell_id", "gene_id"], "left").fillna(0.0, ["value"])


def zero_fraction(expr: DataFrame, cells: DataFrame, by: str | None = None) -> DataFrame:
    """(by, gene_id, zero_fraction) over all cells; a gene that a batch has nowhere is there with 1."""
    keys = [by] if by else []
    size = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    held = expr.where("value <> 0")
    held = held.join(cells.select("cell_id", *keys), "cell_id") if by else held
    some = held.groupBy(*keys, "gene_id").agg(F.count("*").alias("nnz"))
    grid = size.crossJoin(expr.select("gene_id").distinct())
    return grid.join(some, [*keys, "gene_id"], "left").select(*keys, "gene_id", (1 - F.coalesce("nnz", F.lit(0)) / F.col("n_cells")).alias("zero_fraction"))


def expressed(expr: DataFrame, cells: DataFrame, most_zero: float, by: str | None = None) -> DataFrame:
    """Genes (by batch) whose zero fraction is most_zero at most. One count of the values that are not zero."""
    keys = [by] if by else []
    size = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    if most_zero >= 1:  # genes without any value count as well
        return zero_fraction(expr, cells, by).drop("zero_fraction")
    held = expr.where("value <> 0")
    held = held.join(cells.select("cell_id", *keys), "cell_id") if by else held
    some = held.groupBy(*keys, "gene_id").agg(F.count("*").alias("nnz"))
    joined = some.join(size, keys) if by else some.crossJoin(size)
    return joined.where(F.round(1 - F.col("nnz") / F.col("n_cells"), 9) <= most_zero).select(*keys, "gene_id")


def subset(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def control_mask(genes: DataFrame, controls: DataFrame) -> DataFrame:
    """genes with is_ctl; an empty intersection is an error of the caller's validation."""
    return genes.join(controls.select("gene_id", F.lit(True).alias("is_ctl")).distinct(), "gene_id", "left").fillna(False, ["is_ctl"])


def stack(parts: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Tables of cells (or of expressions) as one, with a batch column: the names given, or "batch 1", "batch 2", ... by position."""
    names = names or [f"batch {i}" for i in range(1, len(parts) + 1)]
    if len(names) != len(parts):
        raise ValueError("as many batch names as tables are needed")
    out = None
    for part, name in zip(parts, names, strict=True):
        one = part.drop("batch").withColumn("batch", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def combine(expr: DataFrame, cells: DataFrame, method: str = "intersect", batch_cut: float = 0.01, overall_cut: float = 0.01) -> DataFrame:
    """Batches on the genes that all of them express (intersect), or any of them and enough cells overall (union)."""
    if method not in ("intersect", "union"):
        raise ValueError("method is intersect or union")
    kept = expressed(expr, cells, 1 - batch_cut, "batch")
    if method == "intersect":
        n = cells.agg(F.countDistinct("batch").alias("n"))  # one row
        genes = kept.groupBy("gene_id").agg(F.countDistinct("batch").alias("c")).crossJoin(n).where("c = n").select("gene_id")
    else:
        genes = kept.select("gene_id").distinct().join(expressed(expr, cells, 1 - overall_cut), "gene_id", "left_semi")
    return subset(expr, genes)
