"""Cells dealt to pairs of blocks, for work that compares all pairs.

There are so many blocks that the pairs of blocks keep the cores busy, and no more: a cell travels to as many pairs as
there are blocks it meets, so what is exchanged grows with the cells and not with their square. Only where such a block
would take more than BYTES are there more of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a block has at least, if there are so many; bytes of values that it has at most; pairs of blocks wanted for each core.
LEAST, BYTES, TASKS = 1024, 64 << 20, 8
#: Partitions that pairs are dealt over at most.
MOST = 4096


def block_cells(points: DataFrame, n: int, values: str = "values") -> int:
    """Cells of a block, of n in all."""
    first = points.select(F.size(values)).first()
    wanted = int(np.ceil(np.sqrt(2 * TASKS * points.sparkSession.sparkContext.defaultParallelism)))
    return min(max(LEAST, -(-n // wanted)), max(1, BYTES // (8 * max(first[0] if first else 1, 1))))


def dealt(points: DataFrame, sizes: dict, across: bool, block: int, batch: str = "batch") -> DataFrame:
    """points with left, right and side: every cell for each pair of blocks it takes part in, 0 where its block is the left one.

    sizes: cells by batch. across: blocks meet those of the batches after theirs; else those of their own batch, each pair
    once, and a block that meets itself comes once, as the left one. Rows of a pair are in one partition.
    """
    spark, of = points.sparkSession, {}
    for b in sorted(sizes):
        for i in range(-(-sizes[b] // block)):
            of[b, i] = len(of)
    meet = [(p, q) for (a, _), p in of.items() for (b, _), q in of.items() if (a < b if across else a == b and p <= q)]
    kind = dict(points.dtypes)[batch]
    parts = spark.createDataFrame([(b, of[b, 0], -(-n // block)) for b, n in sizes.items() if n], f"`{batch}` {kind}, _first int, _parts int")
    rows = [(p, p, q, 0) for p, q in meet] + [(q, p, q, 1) for p, q in meet if p != q]
    pairs = spark.createDataFrame(rows, "_own int, left int, right int, side int")
    own = points.join(F.broadcast(parts), batch).withColumn("_own", F.col("_first") + F.pmod(F.xxhash64("cell_id"), F.col("_parts")).cast("int"))
    got = own.join(F.broadcast(pairs), "_own").select(*points.columns, "left", "right", "side")
    return got.repartition(min(max(len(meet), 1), MOST), "left", "right")
