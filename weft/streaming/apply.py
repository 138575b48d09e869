"""Stored factors on a stream of cells: the adjustment keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.bulk import BulkMerge, apply_factors


def adjusted_stream(cells: DataFrame, merged: BulkMerge, k: int = 20) -> DataFrame:
    """A stream (or a table) of cells (cell_id, values, ...) adjusted by the factors of a merge."""
    return apply_factors(cells, merged, k)


def cell_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files below folder whose names match the pattern; a table in part files is a folder of that name."""
    found = pattern if any(c in pattern for c in "*?[{") else f"{pattern[:-1]}[{pattern[-1]}]"  # a stream's path is a folder or a pattern
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{found}")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Writes what the stream has now below folder, exactly once over restarts, and reads it."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/cells").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/cells")
