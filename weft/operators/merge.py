"""The cell-level entry point: check, drop zeros, find replicates, remove unwanted variation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import linear
from .features import choose_genes
from .replicate import find_replicates
from .validate import check_blocks


def without_zeros(blocks: DataFrame, genes: bool = True) -> tuple[DataFrame, np.ndarray | None]:
    """blocks without the cells (and genes) that are zero throughout, both judged on the input; a mask of the genes left, or None."""
    kept = blocks.where(F.exists("values", lambda x: x != 0))
    if not genes:
        return kept, None
    some = linear.total_arrays(blocks, lambda x: (x != 0).astype(float))[1] > 0
    return (kept, None) if some.all() else (linear.transform(kept, {"values": lambda y: y[:, some]}), some)


def merge_cells(blocks: DataFrame, controls: np.ndarray, ks: list[int] | int = 20, svd_k: int = 50, cell_type: str | None = "cell_type", score_type: str = "cell_type", names: list[str] | None = None, value: str = "values", batch: str = "batch", marker: list[int] | None = None, marker_list: dict | None = None, variable: bool = False, solver: str = "exact", **replicate_options) -> linear.Merged:
    """blocks(cell_id, batch, values, cell_type) adjusted: the best of several k as values, all of them under names.

    value and batch name the columns to take. Clustering and matching look at the markers, at the union of the lists in
    marker_list, or, if variable, at variable genes; else at all genes. Genes that are zero throughout are left out of
    the results; Merged.genes holds the positions of the others.
    """
    ks = [ks] if isinstance(ks, int) else list(ks)
    controls = np.asarray(controls, bool)
    check_blocks(blocks, controls, cell_type, ks=ks, names=names, value=value, batch=batch, genes=marker)
    ready = blocks if value == "values" else blocks.drop("values").withColumnRenamed(value, "values")
    ready = ready if batch == "batch" else ready.drop("batch").withColumnRenamed(batch, "batch")
    ready, some = without_zeros(ready)
    place = np.arange(len(controls)) if some is None else np.flatnonzero(some)
    genes = None
    if marker is not None or marker_list is not None or variable:
        back = {int(p): i for i, p in enumerate(place)}
        given = choose_genes(ready, marker, marker_list)
        genes = given if marker is None and marker_list is None else [back[g] for g in given if g in back]
    if not controls[place].any():
        raise ValueError("no control gene")
    labels = materialize(find_replicates(ready, cell_type=cell_type, genes=genes, **replicate_options).select("cell_id", "replicate"), "labels")
    out = linear.adjust_scaled(ready.join(labels, "cell_id"), "replicate", "batch", controls[place], ks, svd_k, score_type, names, solver)
    return linear.Merged(out.blocks.drop("replicate"), out.alpha, out.k, out.scores, place)
