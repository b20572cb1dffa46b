"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the capacity; a piece goes to the open
bin with the least room that still takes it and has no conflict with it.  Open
bins are kept in order of their residual; each carries a bitmap of the sources
that have reached their limit and a bitmap of the duplicate clusters it holds.
The search starts at the first bin with enough room and goes on to its
successors until a compatible one is found; if there is none a bin is opened.

Pieces are dealt to shards of bounded size by a hash, and each shard is packed
by one task.  The number of shards follows the number of pieces, so the work
per shard does not grow with the corpus.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, text_of

CAPACITY = 4096          # words a bin
MAX_PER_SOURCE = 8       # pieces of one source in a bin
SHARD_PIECES = 4096


class Packer:
    """Best fit for one shard; ``place`` returns the bin and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE):
        self.capacity, self.max_per_source = capacity, max_per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.full_sources: list[int] = []       # bitmap per bin: sources at their limit
        self.clusters: list[int] = []           # bitmap per bin: clusters present
        self.counts: list[dict[int, int]] = []
        self.source_bits: dict = {}
        self.cluster_bits: dict = {}

    @staticmethod
    def _bit(known: dict, value) -> int:
        return 1 << known.setdefault(value, len(known))

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        source, cluster = self._bit(self.source_bits, source), self._bit(self.cluster_bits, cluster)
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, b = self.order[at]
            if not (self.full_sources[b] & source or self.clusters[b] & cluster):
                break
            at += 1
        else:
            b, residual = len(self.clusters), self.capacity
            self.full_sources.append(0)
            self.clusters.append(0)
            self.counts.append({})
            at = None
        if at is not None:
            del self.order[at]
        self.clusters[b] |= cluster
        n = self.counts[b][source] = self.counts[b].get(source, 0) + 1
        if n >= self.max_per_source:
            self.full_sources[b] |= source
        bisect.insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def n_words(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cluster_key(text):
    """Copies up to case (A-Z) and white space share a cluster."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " ")))


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """``(doc_id, source, cluster, piece, size, copy)``: whole texts in pieces of
    at most ``capacity`` words.  Equal rows are counted first and numbered by
    ``copy``, so they can be dealt to different shards, the same way each time."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       n_words(text).alias("words"), cluster_key(text).alias("cluster"))
    rows = rows.groupBy("doc_id", "source", "words", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("long")
    return (rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("doc_id", "source", "cluster", "piece", "copy",
                    F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("size")))


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE,
         shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """``(doc_id, piece, copy, source, cluster, size, bin_id, bin_offset)``, one
    row per piece.

    A bin's sizes sum to ``capacity`` at most; it never holds two pieces of one
    duplicate cluster (so no two pieces of one document either) nor more than
    ``max_per_source`` of one source.  Pieces of a shard are placed in order of
    falling size, ties by id, piece and copy.  Null and empty texts are pieces
    of size 0; all null sources count as one source; a null id is kept; equal
    rows are numbered by ``copy``; an empty table gives an empty table; other
    columns are not read.
    """
    items = stored(pieces(docs, capacity, id_col, text_col, source_col), "pieces")
    shards = max(1, math.ceil(items.count() / shard_pieces))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "piece", "copy"),
                                             F.lit(shards)).cast("long"))
    names = ["doc_id", "piece", "copy", "source", "cluster", "size"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece", "copy", "source", "cluster"],
                                ascending=[False, True, True, True, True, True], kind="stable")
        packer = Packer(capacity, max_per_source)
        placed = [packer.place(int(s), None if pd.isna(src) else src, c)
                  for s, src, c in zip(rows["size"], rows["source"], rows["cluster"])]
        out = rows[names].copy()
        out["bin_id"] = [int(rows["shard"].iloc[0]) << 32 | b for b, _ in placed]
        out["bin_offset"] = [o for _, o in placed]
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return dealt.groupBy("shard").applyInPandas(
        run, "doc_id long, piece long, copy long, source string, cluster long, size long, bin_id long, bin_offset long")
