"""Helpers shared by the training-data operators: table access, Arrow batches, vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rfmspark.session import prepare

U64 = np.uint64
#: Text bytes that one numpy kernel call handles; a longer single text is handled whole.
SLICE_BYTES = 1 << 20


def setup(spark: SparkSession) -> None:
    """Session settings, shared checkpoint folder, and the library's code for the Python workers."""
    prepare(spark)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the action that wrote them has ended; meant for steps that end in checkpoints."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def slices(batch: pa.RecordBatch, column: str, target: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``target`` bytes, so kernels use bounded memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, lo = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > target:
            yield batch.slice(lo, i - lo)
            total, lo = 0, i
        total += int(n)
    if lo < batch.num_rows:
        yield batch.slice(lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each text and the end) of a string column; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses modulo 2^64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(BASES[seed]) + U64(seed))


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size, base = max(n, SLICE_BYTES + 1024), BASES[seed]
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _POWERS[seed] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have[0][:n], have[1][:n]


def prefix_hash(buf: np.ndarray, seed: int = 0) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(byte_table(seed)[buf] * powers(seed, len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of bytes start:end, the same wherever they stand."""
    inverse = powers(seed, len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and the word number at which each text begins (with the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def rolling(values: np.ndarray, width: int, step: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hash of each ``width`` consecutive values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(width):
        out = out * U64(step) + values[i:i + n]
    return mix(out)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # order-preserving packing: the value's high bits, then the place, so ties fall to the left
    best = np.arange(len(values), dtype=np.int64)
    key = values
    span = 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(key[b] < key[a], b, a)
        span *= 2
    rest = width - span
    if rest:
        a, b = best[:-rest], best[rest:]
        best = np.where(key[b] < key[a], b, a)
    return best[:n]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of 0..n-1 that lie in any start:end."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
