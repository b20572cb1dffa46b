"""Helpers shared by the operators of this package.

Texts travel through Arrow batches; inside a task they are handled in blocks
of a bounded number of bytes, so memory does not depend on the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 512

# Arrow batches of this session's Python operators
_BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
               "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Make Arrow batches small: a batch of texts is held in the JVM's direct
    memory, in the Python worker, and once more on the way back, so its size is
    what bounds a task's memory.  Spark reads these settings when a job runs;
    smaller ones that the session already has are left alone."""
    for key, most in _BATCH_CONF.items():
        now = spark.conf.get(key, None)  # None unless somebody set it
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later steps
    neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    if len(offsets):
        data = data[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
    return data, offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of whole rows of about ``limit`` bytes each (a longer row alone)."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


# ---------------------------------------------------------------- word hashes

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_FACTOR = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for k, b in (("p", BASE), ("i", INVERSE)):
            v = np.full(size, np.uint64(b & (2**64 - 1)), dtype=np.uint64)
            v[0] = 1
            _powers[k] = np.cumprod(v, dtype=np.uint64)
    p, i = _powers["p"][:n], _powers["i"][:n]
    if len(_powers["p"]) > 8 * BLOCK_BYTES:  # one very long row: not kept
        _powers.clear()
    return p, i


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: see ``span_hash``."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * p[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` from ``prefix_hash(data)``; equal
    bytes give equal hashes wherever they stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Words of a block of rows: hash of each word, its row, and the bounds in
    a copy of the bytes with one separator after each row.  ``table`` maps a
    byte to the byte that is hashed, or to 0 if it separates words."""
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(lens)), lens)
    flat = np.zeros(len(data) + len(lens), dtype=np.uint8)
    flat[np.arange(len(data)) + row] = table[data]
    inside = np.zeros(len(flat) + 2, dtype=bool)
    inside[1:-1] = flat != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    hashes = span_hash(prefix_hash(flat), start, end)
    row_end = np.cumsum(lens + 1)
    return hashes, np.searchsorted(row_end, start, side="right"), start, end


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``n`` words of one row, and the rows."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h += words[k:k + m] * WORD_FACTOR[k]
    ok = rows[:m] == rows[n - 1:n - 1 + m]
    return mix(h[ok] + np.uint64(n)), rows[:m][ok]
