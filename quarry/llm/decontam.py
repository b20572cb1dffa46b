"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are partitioned by their number of distinct shingles into
classes of sizes [2**c, 2**(c+1)).  A class fixes its MinHash sketch: the
``floor((1 - t) * largest) + 1`` least shingle hashes of an item.  A document
that contains a share t or more of an item misses fewer shingles than the
sketch has, so it holds at least one of them: the search loses nothing, however
long the document is.  (A sketch of the document would: a short item is a
vanishing part of a long text's minima.)  Documents are partitioned by size
too: a class is only probed by documents with enough shingles to contain a
share t of its smallest item.  Candidates are verified by exact containment of
the shingles themselves.

The item side is read in blocks, each of bounded size; each block's sketches go
to the executors and the corpus is scanned once per block.  The driver collects
the items while the plan is built, so they must fit there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, byte_rows, mix, row_blocks, shingle_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
ITEM_BLOCK_BYTES = 4 << 20  # item text held by the driver and sent to each executor at once

WORD_BYTES = np.zeros(256, dtype=np.uint8)
WORD_BYTES[0x80:] = np.arange(0x80, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    WORD_BYTES[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_BYTES[_c] = _c + 32
_FOLD = bytes(int(b) or 0x20 for b in WORD_BYTES)
_SKETCH_SEED = np.uint64(0x5851F42D4C957F2D)


def fold(text: bytes) -> list[bytes]:
    """Words: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


def shingles(words: list[bytes], n: int) -> set:
    return set(zip(*(words[k:] for k in range(n))))


class Item:
    def __init__(self, item_id, text: bytes, shingle: int, threshold: float):
        words = fold(text)
        self.item_id = item_id
        self.length = min(shingle, len(words))  # a shorter item is one shingle of all its words
        self.shingles = shingles(words, self.length) if words else set()
        self.size = len(self.shingles)
        self.need = max(1, math.ceil(threshold * self.size - 1e-9))
        if words:
            data = np.frombuffer(text, dtype=np.uint8)
            h, row, _, _ = words_of(data, np.array([0, len(data)]), WORD_BYTES)
            self.hashes = np.unique(shingle_hashes(h, row, self.length)[0])
            self.size_class = self.size.bit_length() - 1
            largest = (2 << self.size_class) - 1
            k = math.floor((1 - threshold) * largest + 1e-9) + 1
            order = np.argsort(mix(self.hashes ^ _SKETCH_SEED))
            self.sketch = self.hashes[order[:k]]


class Index:
    """The sketches of one block of items, by shingle length and size class."""

    def __init__(self, rows, shingle: int, threshold: float):
        items = [Item(i, t or b"", shingle, threshold) for i, t in rows]
        self.items = [x for x in items if x.size]
        self.parts = []
        for length, size_class in sorted({(x.length, x.size_class) for x in self.items}):
            members = [k for k, x in enumerate(self.items) if (x.length, x.size_class) == (length, size_class)]
            keys = np.concatenate([self.items[k].sketch for k in members])
            owner = np.concatenate([np.full(len(self.items[k].sketch), k) for k in members])
            order = np.argsort(keys, kind="stable")
            least = max(1, math.ceil(threshold * (1 << size_class) - 1e-9))
            self.parts.append((length, least, keys[order], owner[order]))
        self.lengths = sorted({p[0] for p in self.parts})
        # one bit for each value of a hash's top 20 bits: most shingles stop here
        self.maybe = {n: np.zeros(1 << 20, dtype=bool) for n in self.lengths}
        for length, _, keys, _ in self.parts:
            self.maybe[length][(keys >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a sketch value."""
        words, rows, _, _ = words_of(data, offsets, WORD_BYTES)
        found = set()
        for length in self.lengths:
            h, r = shingle_hashes(words, rows, length)
            sizes = np.bincount(r, minlength=len(offsets) - 1)  # with repeats: never too small
            near = self.maybe[length][(h >> np.uint64(44)).astype(np.int64)]
            h, r = h[near], r[near]
            for n, least, keys, owner in self.parts:
                if n != length or not len(h):
                    continue
                big = sizes[r] >= least
                lo = np.searchsorted(keys, h[big], side="left")
                hi = np.searchsorted(keys, h[big], side="right")
                for k in np.flatnonzero(hi > lo):
                    row = int(r[big][k])
                    found.update((row, int(o)) for o in owner[lo[k]:hi[k]])
        return found

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, Item, int]]:
        """(row, item, shared shingles) of all contained items, verified on the shingles."""
        by_row: dict[int, list[int]] = {}
        for row, item in sorted(self.candidates(data, offsets)):
            by_row.setdefault(row, []).append(item)
        out = []
        for row, items in by_row.items():
            words = fold(data[offsets[row]:offsets[row + 1]].tobytes())
            have = {n: shingles(words, n) for n in {self.items[k].length for k in items}}
            for k in items:
                item = self.items[k]
                n = len(item.shingles & have[item.length])
                if n >= item.need:
                    out.append((row, item, n))
        return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, limit: int = ITEM_BLOCK_BYTES):
    """The items in blocks of about ``limit`` bytes of text, by a hash of the row."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"),
                        F.col(text_col).cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length(F.col(text_col)) + 64)).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.item_id, bytes(r.text) if r.text is not None else b"") for r in part.collect()]


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)``: a row for each
    document row and distinct item with ``threshold`` or more of the item's
    distinct shingles in the document.

    An item of fewer than ``shingle`` words is one shingle of all its words; an
    item without words (null, empty) is in no document, and a text without
    words contains nothing.  Null and repeated ids are returned as they come;
    empty tables give an empty table; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, n_shingles long, n_found long, containment double"
    sc = docs.sparkSession.sparkContext

    def scan(block):
        shared = sc.broadcast(block)

        def run(batches):
            index = Index(shared.value, shingle, threshold)
            for b in batches:
                data, offsets = byte_rows(b.column(1))
                for i, j in row_blocks(offsets):
                    hits = index.search(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    if hits:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([i + h[0] for h in hits])),
                             pa.array([h[1].item_id for h in hits], pa.int64()),
                             pa.array([h[1].size for h in hits], pa.int64()),
                             pa.array([h[2] for h in hits], pa.int64()),
                             pa.array([h[2] / h[1].size for h in hits], pa.float64())],
                            ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        return src.mapInArrow(run, schema)

    out = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        part = scan(block)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
                  block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that contain an item, by the same search; all
    columns as they are, no shuffle."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    sc = docs.sparkSession.sparkContext

    def filtered(df, block):
        shared = sc.broadcast(block)

        def run(batches):
            index = Index(shared.value, shingle, threshold)
            for b in batches:
                data, offsets = byte_rows(b.column(place))
                clean = np.ones(b.num_rows, dtype=bool)
                for i, j in row_blocks(offsets):
                    for row, _, _ in index.search(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]):
                        clean[i + row] = False
                yield b.filter(pa.array(clean))

        return df.mapInArrow(run, df.schema)

    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        docs = filtered(docs, block)
    return docs


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS j, item_id, w, least(5, len(w)) AS n FROM (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  WHERE len(w) > 0),
si AS (
  SELECT DISTINCT j, item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
ni AS (SELECT j, count(*) AS n_shingles FROM si GROUP BY j),
sd AS (
  SELECT DISTINCT k, doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT k, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d JOIN (SELECT DISTINCT n FROM i) ON len(w) >= n)),
f AS (
  SELECT k, doc_id, j, item_id, count(*) AS n_found
  FROM sd JOIN si USING (n, g) GROUP BY k, doc_id, j, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN ni USING (j) WHERE 10 * n_found >= 8 * n_shingles
"""
