"""Exact medians of every column by group, and cells ranked by their distance to them; no group is gathered.

Doubles are read as whole numbers of the same order, and the middle ones are found digit by digit: a pass counts the
digits of the values that agree with what is known so far, by (group, column), combined where they arise. When few
values are left they are fetched instead. What is held is a histogram for each group and column, whatever the cells.

Defined cases: a group of an even number has the mean of its two middle values; -0.0 and 0.0 are one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import HELD, added, fields, lists, matrix
from .stats import average_ranks

#: Values in all that are fetched in the end; columns up to which a digit has 8 bits (4 beyond); bytes of medians sent at once.
FETCHED, NARROW, SENT = 1 << 20, 4096, 64 << 20
TOP = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >= TOP, ~bits, bits | TOP)


def doubles(u: np.ndarray) -> np.ndarray:
    return np.where(u >= TOP, u & ~TOP, ~u).view(np.float64)


def _groups(rb: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    x = matrix(rb.column("values"))
    of: dict = {}
    code = np.array([of.setdefault(k, len(of)) for k in zip(*(rb.column(c).to_pylist() for c in by), strict=True)])
    for key, c in of.items():
        yield key, x[code == c]


def _digits(blocks: DataFrame, by: list[str], known: dict, shift: int, bits: int) -> dict:
    """{group: targets by columns by digits} counts of the next digit among values that agree with known (targets by columns) above it."""
    sent = blocks.sparkSession.sparkContext.broadcast(known)
    size = 1 << bits

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, v in held.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds, strict=True)), pa.array([1], pa.int64()), lists(v.reshape(1, -1))], [*by, "n", "values"])
            held.clear()

        for rb in batches:
            if not rb.num_rows:
                continue
            kinds = [rb.schema.field(c).type for c in by]
            for key, x in _groups(rb, by):
                u, prefix = ordered(x), sent.value[key]
                place = ((u >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) + np.arange(x.shape[1]) * size
                made = []
                for p in prefix:
                    same = np.ones(x.shape, bool) if shift + bits == 64 else (u >> np.uint64(shift + bits)) == p >> np.uint64(shift + bits)
                    made.append(np.bincount(place[same], minlength=x.shape[1] * size))
                made = np.concatenate(made).astype(float)
                held[key] = held[key] + made if key in held else made
                if len(held) * made.nbytes > HELD:
                    yield from out()
        yield from out()

    got = added(blocks.select(*by, "values").mapInArrow(part, f"{fields(blocks, *by)}, n long, values array<double>"), *by)
    return {tuple(r[c] for c in by): np.array(r["values"]).reshape(*known[tuple(r[c] for c in by)].shape, size) for r in got.toLocalIterator()}


def _fetched(blocks: DataFrame, by: list[str], known: dict, shift: int) -> dict:
    """{(group, target, column): sorted values} that agree with known above shift."""
    sent = blocks.sparkSession.sparkContext.broadcast(known)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            kinds = [rb.schema.field(c).type for c in by]
            for key, x in _groups(rb, by):
                u = ordered(x)
                for t, p in enumerate(sent.value[key]):
                    same = np.ones(x.shape, bool) if shift == 64 else (u >> np.uint64(shift)) == p >> np.uint64(shift)
                    row, col = np.nonzero(same)
                    yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(row), kind) for k, kind in zip(key, kinds, strict=True)), pa.array([t] * len(row), pa.int32()), pa.array(col, pa.int32()), pa.array(x[row, col])], [*by, "t", "col", "v"])

    got = blocks.select(*by, "values").mapInArrow(part, f"{fields(blocks, *by)}, t int, col int, v double").toArrow()
    out: dict = {}
    keys = list(zip(*(got[c].to_pylist() for c in (*by, "t", "col")), strict=True))
    for key, v in zip(keys, got["v"].to_pylist(), strict=True):
        out.setdefault((key[:-2], key[-2], key[-1]), []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def group_medians(blocks: DataFrame, *by: str, fetched: int = FETCHED) -> dict:
    """{group: the exact median of each column}. blocks(by, values)."""
    by = list(by)
    size = {tuple(r[c] for c in by): (r["n"], r["w"]) for r in blocks.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("values")).alias("w")).collect()}
    if not size:
        return {}
    bits = 8 if max(w for _, w in size.values()) <= NARROW else 4
    rank = {g: np.array([[r] * w for r in sorted({(n - 1) // 2, n // 2})]) for g, (n, w) in size.items()}
    known = {g: np.zeros(r.shape, np.uint64) for g, r in rank.items()}
    left = {g: np.full(r.shape, size[g][0]) for g, r in rank.items()}
    shift = 64
    while shift and sum(int(x.sum()) for x in left.values()) > fetched:
        shift -= bits
        for g, count in _digits(blocks, by, known, shift, bits).items():
            total = np.cumsum(count, 2).astype(np.int64)
            digit = (total <= rank[g][:, :, None]).sum(2)
            below = np.where(digit > 0, np.take_along_axis(total, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
            left[g] = np.take_along_axis(count, digit[:, :, None], 2)[:, :, 0].astype(np.int64)
            rank[g] = rank[g] - below
            known[g] = known[g] | (digit.astype(np.uint64) << np.uint64(shift))
    if shift:
        found = _fetched(blocks, by, known, shift)
        value = {g: np.array([[found[g, t, c][int(x)] for c, x in enumerate(row)] for t, row in enumerate(r)]) for g, r in rank.items()}
    else:
        value = {g: doubles(k) for g, k in known.items()}
    return {g: v.mean(0) for g, v in value.items()}


def centroid_rank(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, cell_id, distance, dist_prop): squared distance to the group's median, and its rank over the group's size. blocks(cell_id, by, values)."""
    middle = group_medians(blocks, *by)
    sent_bytes = sum(v.nbytes for v in middle.values())
    lots = max(1, -(-sent_bytes // SENT))
    names, out = sorted(middle, key=str), None
    for i in range(lots):
        some = {g: middle[g] for g in names[i::lots]}
        sent = blocks.sparkSession.sparkContext.broadcast(some)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if not rb.num_rows:
                    continue
                x, keys = matrix(rb.column("values")), list(zip(*(rb.column(c).to_pylist() for c in by), strict=True))
                at = [j for j, k in enumerate(keys) if k in sent.value]
                d = np.array([((x[j] - sent.value[keys[j]]) ** 2).sum() for j in at], float)
                kept = rb.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in by), kept.column("cell_id"), pa.array(d)], [*by, "cell_id", "distance"])

        part = blocks.select(*by, "cell_id", "values").mapInArrow(rows, f"{fields(blocks, *by, 'cell_id')}, distance double")
        out = part if out is None else out.unionByName(part)
    rounded = out.withColumn("distance", F.round("distance", 9))
    return average_ranks(rounded, list(by), "distance").select(*by, "cell_id", "distance", (F.col("_rank") / F.col("_total")).alias("dist_prop"))
