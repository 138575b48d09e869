"""Checks that the entry points run first; each raises ValueError with what is wrong."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(check, n): how often each rule is broken."""
    rules = [
        ("duplicate_cell", cells.groupBy("cell_id").count().where("count > 1")),
        ("missing_batch", cells.where("batch is null")),
        ("missing_cell_type", cells.where("cell_type is null")),
        ("cell_without_row", cells.join(expr, "cell_id", "left_anti")),
        ("row_without_cell", expr.select("cell_id").distinct().join(cells, "cell_id", "left_anti")),
        ("not_finite", expr.where("value is null or isnan(value) or abs(value) = double('inf')")),
    ]
    out = None
    for name, bad in rules:
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.union(one)
    return out


def check(expr: DataFrame, cells: DataFrame, controls: DataFrame | None = None, ks: list[int] | None = None, names: list[str] | None = None, allow_empty: bool = True) -> None:
    for c in ("cell_id", "gene_id", "value"):
        if c not in expr.columns:
            raise ValueError(f"the expression table has no column {c}")
    for c in ("cell_id", "batch"):
        if c not in cells.columns:
            raise ValueError(f"the cells table has no column {c}")
    if names is not None and ks is not None and len(names) != len(ks):
        raise ValueError("as many result names as values of k are needed")
    full = cells if "cell_type" in cells.columns else cells.withColumn("cell_type", F.lit("-"))
    for row in violations(expr, full).where("n > 0").collect():
        if row["check"] != "cell_without_row" or not allow_empty:
            raise ValueError(f"{row['check']}: {row['n']}")
    if controls is not None and expr.join(controls, "gene_id", "left_semi").isEmpty():
        raise ValueError("no control gene is in the expression table")


def check_blocks(blocks: DataFrame, controls: np.ndarray, cell_type: str | None = None, condition: bool = False, genes: list[int] | None = None, keep: np.ndarray | None = None, ks: list[int] | None = None, names: list[str] | None = None, value: str = "values", batch: str = "batch") -> None:
    """What the entry points ask of blocks(cell_id, batch, values[, cell_type, condition]); one pass over them."""
    for c in ("cell_id", batch, value, *([cell_type] if cell_type else []), *(["condition"] if condition else [])):
        if c not in blocks.columns:
            raise ValueError(f"there is no column {c}")
    if ks is not None and (names is not None or len(ks) > 1) and len(names or []) != len(ks):
        raise ValueError("as many result names as values of k are needed")
    if not np.asarray(controls).any():
        raise ValueError("no control gene")
    if genes is not None and (not len(genes) or min(genes) < 0 or max(genes) >= len(controls)):
        raise ValueError("no chosen gene is in the table, or some are beyond it")
    if keep is not None and not np.asarray(keep).any():
        raise ValueError("no gene would be left")
    bad = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = blocks.agg(
        F.count("*").alias("cells"), F.countDistinct("cell_id").alias("ids"), bad(F.col("cell_id").isNull()).alias("null ids"), bad(F.col(batch).isNull()).alias("cells without a batch"),
        bad(F.col(cell_type).isNull() if cell_type else F.lit(False)).alias("cells without a type"), bad(F.col("condition").isNull() if condition else F.lit(False)).alias("cells without a condition"),
        bad(F.coalesce(F.size(value) != len(controls), F.lit(True))).alias("cells of another number of genes"), bad(F.coalesce(F.exists(value, odd), F.lit(True))).alias("cells with values that are no finite numbers"),
    ).first().asDict()
    cells, ids = found.pop("cells"), found.pop("ids")
    if not cells:
        raise ValueError("there are no cells")
    if ids != cells - found["null ids"]:
        found["repeated cell ids"] = cells - ids
    for name, n in found.items():
        if n:
            raise ValueError(f"{n} {name}")


def check_levels(hierarchy: DataFrame) -> None:
    """hierarchy(level, dataset, cell_id, batch): every data set has two batches, no cell twice in a level."""
    if not hierarchy.groupBy("level", "dataset").agg(F.countDistinct("batch").alias("n")).where("n < 2").isEmpty():
        raise ValueError("a data set of a level has one batch only")
    if not hierarchy.groupBy("level", "cell_id").count().where("count > 1").isEmpty():
        raise ValueError("a cell is in two data sets of a level")
