"""Pseudo-replicates: groups of cells believed to be the same across batches, by four routes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .cluster import cluster_batches, lloyd
from .linear import long, transform
from .matching import match_clusters, match_labels
from .medians import centroid_rank


def supervised(blocks: DataFrame, prop: float = 1.0, label: str = "cell_type") -> DataFrame:
    """(cell_id, replicate): the type's label for cells near its centroid, else the cell's own. blocks(cell_id, label, values).

    With prop 1 every cell is near enough, and no distance is taken.
    """
    if prop >= 1:
        return blocks.select("cell_id", F.col(label).cast("string").alias("replicate")).distinct()
    ranked = centroid_rank(blocks, label)
    return ranked.select("cell_id", F.when(F.round("dist_prop", 9) <= prop, F.col(label).cast("string")).otherwise(F.concat(F.lit("cell:"), "cell_id")).alias("replicate"))


def clusters(blocks: DataFrame, k: dict | None, label: str | None = None, prop: float = 1.0) -> DataFrame:
    """(cell_id, batch, cluster, dist_prop, values), from a label (ranked over all batches) or from k-means by batch.

    With prop 1 ranks don't matter and are 0.
    """
    if label:
        got, by = blocks.select("cell_id", "batch", F.col(label).alias("cluster"), "values"), ["cluster"]
    else:
        found = materialize(cluster_batches(blocks, k).select("cell_id", "cluster"), "clusters")
        got, by = found.join(blocks.select("cell_id", "batch", "values"), "cell_id").select("cell_id", "batch", "cluster", "values"), ["batch", "cluster"]
    if prop >= 1:
        return got.withColumn("dist_prop", F.lit(0.0))
    return got.join(centroid_rank(got, *by).select("cell_id", "dist_prop"), "cell_id")


def split_wanted(labels: DataFrame, wanted: DataFrame, high: list[str] | None = None) -> DataFrame:
    """Replicates split by the wanted label (cell_id, wv); with high, only those named."""
    joined = labels.join(wanted, "cell_id")
    split = F.concat_ws("_", "replicate", "wv")
    pick = F.col("replicate").isin(high) if high is not None else F.lit(True)
    return joined.select("cell_id", F.when(pick, split).otherwise(F.col("replicate")).alias("replicate"))


def high_marker(expr: DataFrame, labels: DataFrame, markers: list) -> list[str]:
    """Replicates in the high one of two clusters of marker means, by vote of the markers. Replicates are few."""
    named = labels.where(~F.col("replicate").startswith("cell:"))
    rows = expr.where(F.col("gene_id").isin(markers)).join(named, "cell_id").groupBy("replicate", "gene_id").agg(F.avg("value").alias("m")).collect()
    names, genes = sorted({r["replicate"] for r in rows}), sorted({r["gene_id"] for r in rows})
    x = np.zeros((len(names), len(genes)))
    for r in rows:
        x[names.index(r["replicate"]), genes.index(r["gene_id"])] = r["m"]
    if len(names) < 2:
        return names
    label = lloyd(x, 2)
    votes = [max((1, 2), key=lambda c, g=g: x[label == c, g].mean() if (label == c).any() else -np.inf) for g in range(len(genes))]
    return [n for n, c in zip(names, label, strict=True) if c == max((1, 2), key=votes.count)]


@dataclass
class Replicates:
    """All that finding replicates made: labels(cell_id, replicate), the groups of clusters (grp, batch, cluster; None where
    nothing was matched), each cell's cluster (cell_id, batch, cluster, dist_prop), and the positions of the genes looked at."""

    labels: DataFrame
    groups: DataFrame | None
    clusters: DataFrame | None
    genes: list[int] | None

    def matrix(self) -> DataFrame:
        return indicator(self.labels)


def find_replicates(blocks: DataFrame, **options) -> DataFrame:
    """(cell_id, replicate) of replicates_of()."""
    return replicates_of(blocks, **options).labels


def replicates_of(blocks: DataFrame, k: dict | None = None, prop: float = 1.0, cell_type: str | None = None, match: bool = False, known: DataFrame | None = None, wanted: DataFrame | None = None, markers: list | None = None, metric: str = "cor", genes: list[int] | None = None) -> Replicates:
    """Replicates of blocks(cell_id, batch, values, cell_type).

    cell_type alone: supervised. cell_type with match: clusters are types by batch, matched across batches. With known
    (cell_id): k-means and matching, then the known cells take their type. Otherwise k-means and matching. The last two
    split replicates by wanted (cell_id, wv), those that markers are high in. genes: positions that clustering and
    matching look at (all of them without it); see features.choose_genes.
    """
    if cell_type and match and known is not None:
        raise ValueError("matching of cell types takes no list of known cells")
    if cell_type and not match and known is None:
        if prop >= 1:
            return Replicates(blocks.select("cell_id", F.col(cell_type).cast("string").alias("replicate")), None, None, genes)
        return Replicates(supervised(blocks, prop, cell_type), None, None, genes)
    whole = blocks
    if genes is not None:
        at = np.asarray(genes, np.int64)
        blocks = transform(blocks, {"values": lambda y: y[:, at]})
    if cell_type and match:
        found = clusters(blocks, None, cell_type, prop)
        groups = match_clusters(found, metric)
        return Replicates(match_labels(found.drop("values"), groups, prop).select("cell_id", "replicate"), groups, found.drop("values"), genes)
    if k is None:
        raise ValueError("a number of clusters for each batch is needed")
    found = clusters(blocks, k, prop=prop)
    groups = match_clusters(found, metric)
    labels = match_labels(found.drop("values"), groups, prop).select("cell_id", "replicate")
    if known is not None:
        typed = known.select("cell_id").distinct().join(blocks.select("cell_id", F.col(cell_type).cast("string").alias("t")), "cell_id")
        labels = labels.join(typed, "cell_id", "left").select("cell_id", F.coalesce("t", "replicate").alias("replicate"))
    if wanted is not None:
        labels = split_wanted(labels, wanted, high_marker(long(whole), labels, markers) if markers else None)
    return Replicates(labels, groups, found.drop("values"), genes)


def indicator(labels: DataFrame) -> DataFrame:
    """(cell_id, replicate, member = 1): the replicate matrix in long form; pivot it to export."""
    return labels.select("cell_id", "replicate", F.lit(1).alias("member"))
