"""Shared plumbing: written tables in the cluster's shared folder, byte hashing, chunking.

Nothing here keeps state on one machine: what outlives a stage goes to the
folder that ``spark.checkpoint.dir`` names, as ordinary Parquet.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_MADE: list = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session (as in tests) gets a temporary one; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillmark/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # the session may be gone by then
            return


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as Parquet into the shared folder and read it back."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- bytes

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = pow(int(MULT), -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW: dict[bool, np.ndarray] = {}
#: Powers that a worker keeps; longer tables live as long as they are used.
KEPT_POWERS = 1 << 21


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """MULT**i modulo 2**64 for i < n (or of its inverse)."""
    have = _POW.get(inverse)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), np.uint64(_INV) if inverse else MULT)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if len(have) <= KEPT_POWERS:
            _POW[inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges (lo, hi) whose bytes stay near ``most``; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of bytes that are no separators) and, by row, the first word's index."""
    inside = ~is_sep[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Longer words are hashed by blake2b: a polynomial modulo 2**64 is the same for certain words of some 1,000 bytes, whatever its base.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=total[1:])
    out = mix((total[ends] - total[starts]) * powers(len(data), True)[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out
