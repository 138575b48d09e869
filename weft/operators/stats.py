"""Statistics, normalisations and ranks: grouped aggregates, and ranges with prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def totals(expr: DataFrame, by: str = "cell_id") -> DataFrame:
    return expr.groupBy(by).agg(F.sum("value").alias("total"))


def moments(expr: DataFrame, n_cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, s, ss) of each group of cells and gene, zeros counted: n from n_cells(by without gene_id, n)."""
    keys = [k for k in by if k != "gene_id"]
    sums = expr.groupBy(*by).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    return sums.join(n_cells, keys) if keys else sums.crossJoin(F.broadcast(n_cells))


def gene_means(expr: DataFrame, cells: DataFrame) -> DataFrame:
    n = cells.agg(F.count("*").alias("n"))
    return expr.groupBy("gene_id").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("gene_id", (F.col("s") / F.col("n")).alias("mean"))


def scaling(expr: DataFrame, batch: str = "batch") -> DataFrame:
    """(gene_id, mean, sd) of dense rows: overall mean, pooled within-batch deviation (n cells less n batches)."""
    per = expr.groupBy("gene_id", batch).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.sum("n") - F.count("*"))
    return per.groupBy("gene_id").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(F.greatest(within, F.lit(0.0))).alias("sd"))


def standardize(expr: DataFrame, scale: DataFrame) -> DataFrame:
    return expr.join(scale, "gene_id").withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def unstandardize(expr: DataFrame, scale: DataFrame) -> DataFrame:
    return expr.join(scale, "gene_id").withColumn("value", F.col("value") * F.col("sd") + F.col("mean")).drop("mean", "sd")


def cosine_norm(expr: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Each cell's vector at length one; an aggregate and a join, so that no window gathers a cell's rows."""
    length = expr.groupBy("cell_id").agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(floor)).alias("length"))
    return expr.join(length, "cell_id").withColumn("value", F.col("value") / F.col("length")).drop("length")


def size_factors(expr: DataFrame) -> DataFrame:
    """(cell_id, size_factor): totals over their mean."""
    total = totals(expr)
    return total.crossJoin(F.broadcast(total.agg(F.avg("total").alias("m")))).select("cell_id", (F.col("total") / F.col("m")).alias("size_factor"))


def log_normalize(expr: DataFrame) -> DataFrame:
    return expr.join(size_factors(expr), "cell_id").withColumn("value", F.log2(F.col("value") / F.col("size_factor") + 1)).drop("size_factor")


def residual(expr: DataFrame, by: str) -> DataFrame:
    """Dense rows less the mean of their replicate group."""
    mean = expr.groupBy(by, "gene_id").agg(F.avg("value").alias("m"))
    return expr.join(mean, [by, "gene_id"]).withColumn("value", F.col("value") - F.col("m")).drop("m")


def center(expr: DataFrame, means: DataFrame) -> DataFrame:
    return expr.join(means, "gene_id").withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def anova_f(expr: DataFrame, cells: DataFrame, group: str = "cell_type") -> DataFrame:
    """(gene_id, log2_f) of a one-way analysis of variance; zeros counted; null where it isn't defined."""
    size = cells.groupBy(group).agg(F.count("*").alias("n"))
    sums = expr.join(cells.select("cell_id", group), "cell_id").groupBy(group, "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    whole = cells.agg(F.count("*").alias("total_n"), F.countDistinct(group).alias("k"))
    per = sums.join(size, group).groupBy("gene_id").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).crossJoin(F.broadcast(whole))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("total_n")) / (F.col("k") - 1)
    within = (F.col("ss") - F.col("b")) / (F.col("total_n") - F.col("k"))
    return per.select("gene_id", F.when((within > 0) & (between > 0), F.log2(between / within)).alias("log2_f"))


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scaled to 0..1 over all rows; nulls are left out of the span."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def average_rank(order: Column, *by: str) -> Column:
    """Rank with ties averaged, by windows: for tables of names (genes). Cells are ranked by average_ranks()."""
    w = Window.partitionBy(*by).orderBy(order)
    peers = F.count("*").over(Window.partitionBy(*by, order))
    return F.rank().over(w) + (peers - 1) / 2


def _ranges(df: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df in written ranges of (by, order), numbered _p, and (by, _p, _before, _total): rows of the group in earlier ranges, and in all.

    A group is spread over as many ranges as it needs; the second table has a row for each group and range.
    """
    held = materialize(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    size = held.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return held, size.select(*by, "_p", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))


def row_numbers(df: DataFrame, by: list[str], order: list[str], out: str, total: str) -> DataFrame:
    """df with each row's number within by, from 1, and how many rows its group has. by and order tell rows apart.

    No task holds more than a range: numbers within ranges, and sums of the ranges before.
    """
    held, ranges = _ranges(df, by, order)
    number = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return held.withColumn(out, number).join(ranges, [*by, "_p"]).withColumn(out, F.col(out) + F.col("_before")).withColumnRenamed("_total", total).drop("_p", "_before")


def average_ranks(df: DataFrame, by: list[str], value: str, key: str = "cell_id", **more: str) -> DataFrame:
    """df with _rank, the rank of value within by (ties averaged), and _total, the rows of the group; more: least="..." and most="..." name columns of the group's extreme ranks.

    Equal values may fill many ranges: runs of a value are counted by range, added up by value, and joined by (range, value).
    """
    held, ranges = _ranges(df, by, [value, key])
    runs = held.groupBy(*by, "_p", value).agg(F.count("*").alias("_n"))
    past = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.coalesce(F.sum("_n").over(past), F.lit(0))).join(ranges, [*by, "_p"])
    whole = runs.groupBy(*by, value).agg(F.min(F.col("_before") + F.col("_start")).alias("_low"), F.sum("_n").alias("_peers"))
    whole = whole.select(*by, value, (F.col("_low") + (F.col("_peers") + 1) / 2).alias("_rank"))
    if more:
        ends = whole.groupBy(*by).agg(*([F.min("_rank").alias(more["least"])] if "least" in more else []), *([F.max("_rank").alias(more["most"])] if "most" in more else []))
        whole = whole.join(ends, by)
    placed = runs.select(*by, "_p", value, "_total").join(whole, [*by, value])
    return held.join(placed, [*by, "_p", value]).drop("_p")


def equal_width_bins(df: DataFrame, value: str, by: str, k: int, key: str = "cell_id") -> DataFrame:
    """bin 1..k: the rank of value within by, cut into k spans of equal width (closed on the right)."""
    ranked = average_ranks(df, [by], value, key, least="_lo", most="_hi")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    place = F.least(F.lit(k), F.greatest(F.lit(1), F.ceil((F.col("_rank") - F.col("_lo")) * k / span)))
    return ranked.withColumn("bin", F.when(span.isNull(), 1).otherwise(place).cast("int")).select(*df.columns, "bin")


def folds(cells: DataFrame, by: str, k: int, seed: int = 1) -> DataFrame:
    """fold 0..min(k, cells)-1: balanced, in a portable pseudo-random order."""
    mixed = cells.withColumn("_mixed", (F.col("cell_id") * 7919 + seed) % 1000003)
    dealt = row_numbers(mixed, [by], ["_mixed", "cell_id"], "_nth", "_all")
    return dealt.withColumn("fold", ((F.col("_nth") - 1) % F.least(F.col("_all"), F.lit(k))).cast("int")).select(*cells.columns, "fold")


def codes(df: DataFrame, by: str, label: str, out: str) -> DataFrame:
    """Labels renumbered 1, 2, ... within by, in their order; only names go through a window."""
    names = df.select(by, label).distinct().withColumn(out, F.dense_rank().over(Window.partitionBy(by).orderBy(label)))
    return df.join(names, [by, label]).select(*df.columns, out)


def f_measure(a: Column, b: Column) -> Column:
    return 2 * a * b / (a + b)


def zero_one(v: Column) -> Column:
    return (v + 1) / 2
