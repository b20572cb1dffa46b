"""Corpus-wide line dedup with levelled sorted runs of line hashes.

A run is a Parquet folder of ``(a, b, n)``: the two 64-bit hashes of a line's
key and the number of documents that hold it, sorted by hash.  Each new batch
of documents is counted, merge-anti-joined with the keys that the runs already
know to be frequent (those need no more counting), and what is left is added as
a run of level 0.  Whenever a level has ``fanout`` runs they are compacted into
one run of the next level.  In the end the frequent keys lose their lines.

All of it is DataFrame operations: lines are split, keyed and counted once per
document inside the row, so counting shuffles one partly aggregated row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, stored, text_of

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 2
BROADCAST_KEYS = 200_000  # frequent keys sent to each task at most (16 bytes each); more are joined by shuffle


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    blank = " \t\n\x0b\x0c\r"
    return F.translate(F.trim(line, F.lit(blank)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(lines: Column, min_chars: int) -> Column:
    """The distinct keys of one document as pairs of hashes."""
    keys = F.filter(F.array_distinct(F.transform(lines, line_key)), lambda k: F.char_length(k) >= min_chars)
    return F.transform(keys, key_hash)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


class LineRuns:
    """The levelled runs, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 fanout: int = FANOUT):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        return stored(counts.select("a", "b", "n").sortWithinPartitions("a", "b"), "line-run")

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("a", "b").agg(F.sum("n").alias("n")) if len(runs) > 1 else out

    def frequent(self) -> DataFrame | None:
        """Keys ``(a, b)`` found in at least ``min_docs`` documents so far."""
        runs = self._runs()
        return self._merged(runs).where(F.col("n") >= self.min_docs).select("a", "b") if runs else None

    def add(self, texts: Column, batch: DataFrame) -> None:
        """Count a batch of documents into a new run of level 0."""
        rows = batch.select(F.explode(_hashes(lines_of(texts), self.min_chars)).alias("h"))
        counts = rows.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        known = self.frequent()
        if known is not None:
            counts = counts.join(known, ["a", "b"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(counts))
        self._compact()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(self.levels[k])))
                self.levels[k] = []
            k += 1


def count_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """The runs after taking in ``docs`` in ``batches`` parts by a hash of the text."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    text = text_of(text_col)
    for k in range(batches):
        runs.add(text, docs.where(F.pmod(F.xxhash64(text), F.lit(batches)) == k))
    return runs


def drop_frequent(docs: DataFrame, frequent: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  min_chars: int = MIN_CHARS) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, the lines and the lines kept; returns
    their names too.  Frequent keys are found per document on hashes alone; the
    texts cross the network once, to meet the list of keys they lose.  Documents
    are told apart by hashes of id and text: equal rows lose the same lines, so
    they may share a key, and copies under different ids are spread."""
    ka, kb, ja, jb, gone, all_lines, kept = fresh(docs, "doc_a", "doc_b", "gone_a", "gone_b", "gone",
                                                  "all_lines", "kept_lines")
    ident = [F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)), F.xxhash64(F.lit(1), text_of(text_col))]
    hashes = docs.select(ident[0].alias("ka"), ident[1].alias("kb"),
                         F.explode(_hashes(lines_of(text_of(text_col)), min_chars)).alias("h"))
    hashes = hashes.select("ka", "kb", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    frequent = stored(frequent, "frequent-lines")
    if frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    lost = (hashes.join(frequent, ["a", "b"], "left_semi")
            .groupBy(F.col("ka").alias(ja), F.col("kb").alias(jb))
            .agg(F.collect_set(F.struct("a", "b")).alias(gone)))
    left = docs.withColumns({ka: ident[0], kb: ident[1]})
    joined = left.join(lost, (left[ka] == lost[ja]) & (left[kb] == lost[jb]), "left")
    lines = lines_of(text_of(text_col))
    joined = joined.withColumn(all_lines, lines)
    keep = F.when(F.col(gone).isNull(), F.col(all_lines)).otherwise(
        F.filter(F.col(all_lines), lambda x: ~F.array_contains(F.col(gone), key_hash(line_key(x)))
                 | (F.char_length(line_key(x)) < min_chars)))
    return joined.withColumn(kept, keep).drop(ka, kb, ja, jb, gone), all_lines, kept


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
               min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` replaced by the lines that stay, joined by a line
    feed, and two more columns ``n_lines`` and ``n_dropped``.

    Lines whose key (of ``min_chars`` code points or more) is in ``min_docs`` or
    more rows go from every row.  A null text is one empty line and becomes the
    empty text; a row is one document, repeated rows count each; null ids are
    kept; an empty table gives an empty table.
    """
    frequent = count_lines(docs, text_col, min_docs, min_chars, batches, fanout).frequent()
    out, all_lines, kept = drop_frequent(docs, frequent, text_col, id_col, min_chars)
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    return out.withColumns({
        text_col: F.array_join(kept, "\n"), n_lines: F.size(all_lines).cast("long"),
        n_dropped: (F.size(all_lines) - F.size(kept)).cast("long")}).drop(all_lines, kept)


def digest(docs: DataFrame, **params) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), **params)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT k, doc_id, p, ls[p] AS line,
         translate(regexp_replace(ls[p], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY k, doc_id
"""
