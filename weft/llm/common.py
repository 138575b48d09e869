"""Shared helpers: scratch tables, flat Arrow text, 64-bit rolling hashes and packed blobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MAX64 = U(2**64 - 1)
#: Multipliers of the public splitmix64 finaliser (fixed values).
MIX1, MIX2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_INV = U(pow(int(GOLD), -1, 2**64))
#: One random odd 64-bit value per byte, drawn from a fixed seed.
BYTE_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where it is unset, a local one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a written table that a later one, written in full, replaces."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._weft_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Text of one hash bucket, about, in bytes.
BUCKET_BYTES = 16 << 20


def parts(df: DataFrame, text_col: str, per: int = 4) -> int:
    """Number of hash buckets: by the bytes of all texts, and a few per shuffle partition at least, so that uneven dealing evens out."""
    held = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(16, per * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-held // BUCKET_BYTES))


def bounds(buckets: int, bits: int) -> np.ndarray:
    """The least value of each bucket, where values of so many bits are dealt out in equal spans."""
    return np.array([-(-(b << bits) // buckets) for b in range(buckets)], U)


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, limit: int = 4 << 20):
    """Row ranges of at most limit bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._table(GOLD, n * 5 // 4), self._table(_INV, n * 5 // 4)
        return self.up, self.down

    @staticmethod
    def _table(base: np.uint64, n: int) -> np.ndarray:
        out = np.ones(n, U)
        m = 1
        while m < n:
            e = min(m, n - m)
            out[m : m + e] = out[:e] * U(pow(int(base), m, 2**64))
            m += e
        return out


POWERS = Powers()


#: Large tables that a worker keeps between tasks of one operator; tasks of others drop them.
KEPT: dict = {}


def trim() -> None:
    """Gives freed memory back to the system: workers outlive tasks and stages, and the next one needs the room."""
    POWERS.up = POWERS.down = np.ones(1, U)
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def lean(f: Callable) -> Callable:
    """f of a group's table, leaving no memory behind in the worker."""

    def run(table: pa.Table) -> pa.Table:
        KEPT.clear()
        try:
            return f(table)
        finally:
            trim()

    return run


def lean_batches(f: Callable, keep: bool = False) -> Callable:
    """f of a task's batches, leaving no memory behind in the worker; keep: what the worker keeps stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            KEPT.clear()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """C, D with hash(buf[s:e]) = (C[e] - C[s]) * D[s] modulo 2**64."""
    up, down = POWERS.get(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U)
    np.cumsum(table[buf] * up[: len(buf)], out=c[1:])
    return c, down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


_OUT = zstandard.ZstdCompressor(level=1)
_IN = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; unpack() gives them back."""
    raw = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw.append(np.array([len(a)], np.int64).tobytes() + f"{a.dtype.str:<8}".encode() + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return _OUT.compress(b"".join(raw))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _IN.decompress(blob)
    out, at = [], 0
    while at < len(raw):
        n, dtype = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 16].decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 16).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += 16 + n * dtype.itemsize
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences."""
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)[0], dtype=U)


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """df without the columns that an operator's outputs replace."""
    taken = {o.lower() for o in outputs}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


def task_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def crc_mod(col: str, n: int) -> str:
    """SQL of crc32(id as text) mod n."""
    return f"crc32(cast({col} as string)) % {n}"
