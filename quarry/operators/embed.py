"""Batch text embedding.

The default provider is a hashed bag of tokens: lower-cased tokens (the
token rule of ``functions.text``) are hashed into ``dim`` buckets with md5,
counted, and the count vector is scaled to unit length.  It needs no model
and no network and is exact in SQL.  A text is one row, so counting needs no
shuffle.

A model provider plugs in through :func:`embed_with_model`, which runs the
model once per Arrow batch with ``mapInPandas`` (model loaded once per
Python worker).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import small_batches

DEFAULT_DIM = 64
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20  # Arrow batches of texts
STEP_TOKENS = 1 << 18  # tokens that a task counts at once


def token_bucket(tok, dim: int = DEFAULT_DIM):
    """``conv(first 8 hex digits of md5(token), 16, 10) % dim``."""
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long")
    return (h % F.lit(dim)).cast("int")


@lru_cache(maxsize=1 << 16)
def _bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:8], 16) % dim


def _steps(sizes):
    """``(first row, rows)`` of stretches of at most ``STEP_TOKENS`` tokens."""
    lo = held = 0
    for k, n in enumerate(sizes):
        if k > lo and held + n > STEP_TOKENS:
            yield lo, k - lo
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes) - lo


def _counted(lists, sizes, dim: int) -> np.ndarray:
    """Tokens per bucket of each list."""
    words = pc.dictionary_encode(lists.flatten())
    buckets = np.array([_bucket(w, dim) for w in words.dictionary.to_pylist()], dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = rows * dim + buckets[words.indices.to_numpy(zero_copy_only=False)] if len(rows) else rows
    return np.bincount(at, minlength=len(sizes) * dim).reshape(len(sizes), dim).astype(np.float64)


def hashed_embedding(df: DataFrame, id_col: str = "id", text_col: str = "text",
                     dim: int = DEFAULT_DIM, out_col: str = "embedding",
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, carry..., embedding array<double>)``, one row per input row (zero
    vector for a text without tokens); rows that share an id stay apart.

    Tokens are cut by Spark; each step of at most ``STEP_TOKENS`` tokens (one
    row at least) hashes its distinct tokens and counts buckets with one NumPy
    histogram, so a task's memory follows neither the table nor its partitions.
    No shuffle.  ``carry`` names columns that travel beside the vector.
    """
    small_batches(df.sparkSession, BATCH_ROWS, BATCH_BYTES)
    src = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)],
                    tokens(F.lower(F.col(text_col))).alias("_t"))

    def run(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False)
            vecs = np.concatenate([_counted(b.column(b.num_columns - 1).slice(lo, n), sizes[lo:lo + n], dim)
                                   for lo, n in _steps(sizes)] or [np.zeros((0, dim))])
            norm = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
            vecs /= np.where(norm > 0, norm, 1.0)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * dim + 1, dim), pa.int32()),
                                           pa.array(vecs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*b.schema.names[:-1], "_v"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    vecs = src.mapInArrow(run, ", ".join([*fields, "_v array<double>"]))
    return vecs.select(F.col("_id").alias(id_col), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)],
                       F.col("_v").alias(out_col))


def embed_with_model(df: DataFrame, encode: Callable, dim: int, id_col: str = "id",
                     text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Embed with a user model: ``encode(list[str]) -> array (n, dim)``.

    ``encode`` is called once per Arrow batch inside executors; load heavy
    models lazily inside it (e.g. a module-level cache) so each Python worker
    loads them once.
    """
    import pandas as pd

    def run(it):
        for pdf in it:
            vecs = np.asarray(encode(pdf[text_col].fillna("").tolist()), dtype=np.float64)
            if vecs.shape != (len(pdf), dim):
                raise ValueError(f"encoder returned shape {vecs.shape}, want ({len(pdf)}, {dim})")
            yield pd.DataFrame({id_col: pdf[id_col], out_col: list(vecs)})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(
        run, f"{id_col} {id_type}, {out_col} array<double>")
