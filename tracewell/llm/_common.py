"""Helpers shared by the text operators: shared-folder tables, Arrow batching, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes handled at once in a Python worker; keeps its word lists to some tens of MB.
CHUNK_BYTES = 2_000_000

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the setting is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id; of a row without one a hash of its text, from 2**62 on, beyond all ids in use; null if it has neither."""
    return F.coalesce(F.col(id_col).cast("long"), F.when(F.col(text_col).isNotNull(), F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(text_col), 3)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[pa.RecordBatch | pa.Table]:
    """Row slices of ``batch`` with about CHUNK_BYTES in the binary or string ``column``; a longer value stands alone."""
    data = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(data).to_pylist()], dtype=np.int64)
    part = np.cumsum(sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


_DRAW = np.random.default_rng(20240600)
_BYTE = _DRAW.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_DRAW.integers(2**62, 2**63, dtype=np.uint64)) | 1)
_SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_SHORT_POWERS = _powers(256)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word between ASCII white space, and its 64-bit hash."""
    solid = _SOLID[data]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    sizes, inside = ends - starts, data[solid]
    first = starts_of(sizes)
    longest = int(sizes.max())
    powers = _SHORT_POWERS if longest <= len(_SHORT_POWERS) else _powers(longest)
    told = _BYTE[inside] * powers[np.arange(len(inside)) - np.repeat(first[:-1], sizes)]
    return starts, ends, mix(np.add.reduceat(told, first[:-1]) + sizes.astype(np.uint64) * _GOLD)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; then of all words in order: 64-bit hash, first and end byte within its text.

    Words stand between ASCII white space. A polynomial over random numbers for bytes, finished by mix(): no word is made
    into an object. Long input is read in parts of about CHUNK_BYTES, cut at white space.
    """
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    each, at = [], 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data) and _SOLID[data[end]]:
            end += 1
        starts, ends, h = _hashed(data[at:end])
        each.append((starts + at, ends + at, h))
        at = end
    starts, ends, h = (np.concatenate(c) for c in zip(*each, strict=True)) if each else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
    begins = starts_of(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)[:-1]
    counts = np.diff(np.searchsorted(starts, begins), append=len(starts)) if texts else np.empty(0, dtype=np.int64)
    shift = np.repeat(begins, counts)
    return counts, h, starts - shift, ends - shift


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive entries of ``h``, built from runs of doubling length."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    done, out, have, level = None, h, 0, 1
    while True:
        if width & level:
            if done is None:
                done, have = out, level
            else:
                m = len(h) - have - level + 1
                done = mix(done[:m] * _GOLD + out[have : have + m] + np.uint64(have + level))
                have += level
        if have == width:
            return done[:n]
        m = len(out) - level
        out = mix(out[:m] * _M1 + out[level : level + m] + np.uint64(level))
        level *= 2


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each of several consecutive runs begins; one more entry for the end."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out
