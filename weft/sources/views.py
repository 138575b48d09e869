"""Expression views over the driver's tables: expr(cell_id, gene_id, value) and cells(cell_id, batch, cell_type, ...).

A long table leaves zeros out; statistics take the number of cells from the cells table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene_id int, value, batch, cell_type): one row a vector component."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding"))
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("pos").alias("gene_id"), F.col("col").cast("double").alias("value"), (F.col("vec_id") % 3).alias("batch"), F.col("label").alias("cell_type"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, values array<double>, batch, cell_type): one row a cell."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("values"), (F.col("vec_id") % 3).alias("batch"), F.col("label").alias("cell_type"))


#: Lines that a partition of a join or a sum holds at most, however many lines there are.
ROWS = 1 << 19


def parts_of(lines: DataFrame) -> int | None:
    """Partitions of ROWS lines; None where a core's share is less, and Spark's own number does."""
    n = -(-lines.count() // ROWS)
    return n if n > lines.sparkSession.sparkContext.defaultParallelism else None


def spread(df: DataFrame, parts: int | None, key: str) -> DataFrame:
    return df.repartition(parts, key) if parts else df


def _joined(left: DataFrame, right: DataFrame, key: str, other: str, parts: int | None) -> DataFrame:
    """An inner join whose tasks sort ROWS lines: partitions are not put together again by their compressed bytes."""
    return spread(left, parts, key).join(spread(right, parts, other), F.col(key) == F.col(other))


def _genes(spark: SparkSession, sf_dir: str, by_type: bool, genes: DataFrame | None) -> DataFrame:
    gene = F.concat_ws("|", "p_brand", "p_type") if by_type else F.col("p_brand")
    part = table(spark, sf_dir, "part").select("p_partkey", gene.alias("gene_id"))
    return part if genes is None else part.join(F.broadcast(genes), "gene_id").drop("gene_id")


def counts(spark: SparkSession, sf_dir: str, by_type: bool = False, genes: DataFrame | None = None) -> DataFrame:
    """Quantities that customers bought by brand (by_type: by brand and type): whole numbers, zeros left out.

    genes(gene_id, pos): numbers that stand for the names, as pos instead of gene_id.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part, parts = _genes(spark, sf_dir, by_type, genes), parts_of(lines)
    bought = _joined(lines, orders, "l_orderkey", "o_orderkey", parts).select("o_custkey", "l_partkey", "l_quantity")
    joined = _joined(bought, part, "l_partkey", "p_partkey", parts).select(F.col("o_custkey").alias("cell_id"), "gene_id" if genes is None else "pos", "l_quantity")
    return spread(joined, parts, "cell_id").groupBy(*joined.columns[:2]).agg(F.sum("l_quantity").alias("value"))


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = parts_of(lines)
    joined = _joined(lines, _genes(spark, sf_dir, True, None), "l_partkey", "p_partkey", parts).select(F.col("l_suppkey").alias("cell_id"), "gene_id", "l_quantity")
    return spread(joined, parts, "cell_id").groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, batch, cell_type, condition): every customer, those without an order too."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("c_custkey").alias("cell_id"), F.col("r_name").alias("batch"), F.col("c_mktsegment").alias("cell_type"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("condition"))


DENSE_SQL = "expr AS (SELECT vec_id AS cell_id, i - 1 AS gene_id, CAST(embedding[i] AS DOUBLE) AS value, vec_id % 3 AS batch, label AS cell_type FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
COUNTS_SQL = "expr AS (SELECT o_custkey AS cell_id, p_brand AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SPARSE_SQL = "expr AS (SELECT o_custkey AS cell_id, p_brand || '|' || p_type AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SUPPLIER_SQL = "expr AS (SELECT l_suppkey AS cell_id, p_brand || '|' || p_type AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CELLS_SQL = "cells AS (SELECT c_custkey AS cell_id, r_name AS batch, c_mktsegment AS cell_type, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS condition FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
