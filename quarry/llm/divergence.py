"""Audit of how the sources of a language differ in their words.

Terms are counted per (lang, source).  A language keeps the terms that enough
of its documents hold; each group and each language gives every kept term a
probability, an exact integer in billionths with additive smoothing, and the
audit compares the probabilities ``p`` and ``q`` of a term by ``|p - q|``.

* Part ``term``, a group against its language, by count-cell ranking: the
  difference depends on the two counts alone, so terms are grouped by (group
  count, lang count), the difference is evaluated once per cell, and cells are
  ranked by the terms before them.  Cells of one value are merged; only the
  cells that reach the ranks asked for are expanded, in UTF-8 order.  No group's
  terms are ever sorted whole.
* Part ``pair``, a group against each other source of its language: each kept
  term is one row with its groups' probabilities, and tasks add the differences
  of blocks of terms into one matrix of integers per language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, stored

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
BLOCK_CELLS = 1 << 20     # terms x sources of one block of probabilities
HELD_CELLS = 1 << 23      # sums of pairs that a task holds before it hands them on

# fixed values: letters of terms, upper case folded; any other ASCII character
# separates terms, and bytes from 0x80 on belong to letters beyond ASCII
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(lang, source, text)`` -> ``(lang, source, term, n, docs)``: a
    term's occurrences in a group and the documents that hold it.  A document
    hands on each of its terms once, with its count, and counts are added up
    before they are shuffled."""
    def run(batches):
        for b in batches:
            terms, counts, row = [], [], []
            for k, text in enumerate(b.column(2)):
                found = Counter(text.as_py().translate(FOLD).split(b" "))
                found.pop(b"", None)
                terms += found
                counts += found.values()
                row += [k] * len(found)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())],
                ["lang", "source", "term", "n"])

    found = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        run, "lang string, source string, term binary, n long")
    return (found.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")))


def probability(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))``
    in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = (wide(count) + F.lit(smoothing).cast("decimal(3,0)")) * F.lit(scale).cast("decimal(12,0)")
    below = wide(total) + wide(terms) * F.lit(smoothing).cast("decimal(3,0)")
    return F.call_function("div", above, below) + F.lit(1).cast("long")


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, lang_n)``: the terms that a language keeps."""
    return (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))


def _top_terms(rows: DataFrame, smoothing: int, scale: int, top: int) -> DataFrame:
    """``rows(lang, source, term, n, lang_n, total, lang_total, terms)`` ->
    ``(lang, source, item, value, rank)``, count-cell ranking."""
    group = ["lang", "source"]
    cells = rows.groupBy(*group, "n", "lang_n", "total", "lang_total", "terms").agg(F.count(F.lit(1)).alias("m"))
    value = (probability(F.col("n"), F.col("total"), F.col("terms"), smoothing, scale)
             - probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smoothing, scale))
    cells = cells.withColumn("value", value).where("value > 0")
    values = cells.groupBy(*group, "value").agg(F.sum("m").alias("m"))
    # each value has a term at least, so no value beyond the top-th is reached
    falling = Window.partitionBy(*group).orderBy(F.col("value").desc())
    values = values.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("before", before).where(F.col("before") < top).select(*group, "value", "before")
    # the cells of these values, then the terms of these cells
    cells = cells.join(reached, [*group, "value"]).select(*group, "n", "lang_n", "value", "before")
    held = rows.join(cells, [*group, "n", "lang_n"]).select(*group, "term", "value", "before")
    among = F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))
    held = held.withColumn("among", among).where(F.col("among") <= top)
    return (held.select(*group, F.col("term").alias("item"), "value", (F.col("before") + F.col("among")).cast("int").alias("rank"))
            .where(F.col("rank") <= top))


def _block_sums(ps: np.ndarray) -> np.ndarray:
    """Sums over terms of the absolute differences of each two columns."""
    out = np.zeros((ps.shape[1], ps.shape[1]), dtype=np.int64)
    for k in range(ps.shape[1] - 1):
        out[k, k + 1:] = np.abs(ps[:, k + 1:] - ps[:, k:k + 1]).sum(axis=0)
    return out


def _pair_sums(by_term: DataFrame) -> DataFrame:
    """``by_term(lang, empty array<long>, held array<struct<no, p>>)``, a row per
    kept term, -> ``(lang, a, b, value)`` with ``a < b``, partial sums.
    ``empty`` holds the probability of a term that a source does not have."""
    def run(batches):
        sums, cells = {}, 0

        def hand_on():
            for lang, m in sums.items():
                a, b = np.triu_indices(len(m), 1)
                for k in range(0, len(a), 1 << 16):
                    x, y = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32()),
                         pa.array(m[x, y], pa.int64())], ["lang", "a", "b", "value"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            held = batch.column(2)
            edge = held.offsets.to_numpy()
            no, p = (held.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for lang in dict.fromkeys(langs):
                rows = np.flatnonzero(langs == lang)
                empty = np.array(batch.column(1)[int(rows[0])].as_py(), dtype=np.int64)
                if lang not in sums:
                    cells += len(empty) ** 2
                    if sums and cells > HELD_CELLS:
                        yield from hand_on()
                        sums.clear()
                        cells = len(empty) ** 2
                    sums[lang] = np.zeros((len(empty), len(empty)), dtype=np.int64)
                step = max(1, BLOCK_CELLS // len(empty))
                for k in range(0, len(rows), step):
                    ps = np.tile(empty, (len(rows[k:k + step]), 1))
                    for r, row in enumerate(rows[k:k + step]):
                        at = slice(edge[row], edge[row + 1])
                        ps[r, no[at]] = p[at]
                    sums[lang] += _block_sums(ps)
        yield from hand_on()

    return by_term.select("lang", "empty", "held").mapInArrow(run, "lang string, a int, b int, value long")


def _pairs(rows: DataFrame, groups: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """Every (group, other source of its language) with its value and rank.
    ``groups(lang, source, total, terms)`` has all groups."""
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    p_of = lambda n: F.when(F.col("terms") > 0, probability(n, F.col("total"), F.col("terms"), smoothing, scale))
    empty = numbered.groupBy("lang").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("no", p_of(F.lit(0)).alias("p")))), lambda x: x["p"]).alias("empty"))
    have = rows.join(numbered.select("lang", "source", "no"), ["lang", "source"]).select("lang", "term", F.struct("no", p_of(F.col("n")).alias("p")).alias("x"))
    by_term = have.groupBy("lang", "term").agg(F.collect_list("x").alias("held")).join(empty, "lang")
    sums = _pair_sums(by_term).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    left = numbered.select("lang", F.col("source"), F.col("no").alias("a"))
    right = numbered.select("lang", F.col("source").alias("item"), F.col("no").alias("b"))
    # a language without kept terms has its pairs too, all of value 0
    both = left.join(right, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left").select(
        "lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("g"),
        F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    return both.select("lang", "g.source", "g.item", "value").withColumn("rank", rank)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE,
               top: int = TOP_TERMS) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``.

    Part ``pair`` has a row for each other source of a group's language, part
    ``term`` the ``top`` terms that the group uses more than its language does;
    ranks go by falling value, then by item in UTF-8 order.  Nulls in text, lang
    and source are empty strings, a repeated row is a document of its own, a
    group without terms takes part in the pairs, an empty table gives an empty
    table, other columns are not read.  Terms come from whole texts.  A language
    has a row for every two sources, so its sources must be a list that such a
    result is wanted for; memory of a task follows their square.
    """
    bounded_batches(docs.sparkSession)
    if min_docs < 1 or smoothing < 1:
        raise ValueError("min_docs and smoothing must be 1 or more")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    counts = stored(term_counts(docs), "term-counts")
    kept = _kept(counts, min_docs)
    rows = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = stored(docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", zero("total"), zero("lang_total"), zero("terms")), "groups")
    rows = rows.join(groups, ["lang", "source"])
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"),
                                      F.col("rank").cast("int").alias("rank"))
    return part(_pairs(rows, groups, smoothing, scale), "pair").unionByName(part(_top_terms(rows, smoothing, scale, top), "term"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
held AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k USING (lang, term) GROUP BY ALL),
sources AS (
  SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.lang_total), 0) AS lang_total,
         coalesce(sum(h.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang) LEFT JOIN held h USING (lang, source)
  GROUP BY g.lang, g.source),
probabilities AS (
  SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (s.total + 5 * s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (s.lang_total + 5 * s.v)::HUGEINT AS q
  FROM sources s JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN probabilities x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN probabilities y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM probabilities WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 50
"""
