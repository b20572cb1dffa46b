"""Quality classifier: regularised quadratic discriminant.

Each whole text becomes a vector of transformed statistics.  Class means and
covariances come from one aggregate over all training rows (sums of products,
combined in each task); each covariance is shrunk towards the diagonal of the
pooled one.  The driver factorises two small matrices once; every document is
then scored from Mahalanobis distances with these cached Cholesky factors.

Statistics of one text depend on each other more than Gaussians say, so plain
log-odds are far too sure.  They are divided by a temperature, the one with the
least log loss on training folds that the moments were taken without.  The loss
is taken against targets a little inside 0 and 1, by the size of each class, so
classes that the training rows separate do not make every score 0 or 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, byte_rows, mix, row_blocks, shingle_hashes, stored, words_of
from .crf import (IS_BANG, IS_CHAR, IS_DIGIT, IS_PIPE, IS_SYMBOL, IS_UPPER, WORD_BYTES, _counts, _distinct, _flag,
                  _repeated)

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
SHRINKAGE = 0.1
TEMPERATURES = tuple(2.0 ** k for k in range(12))
FLOOR = 1e-3  # least variance of a standardised statistic

IS_STOP = _flag(".,;:?")
IS_BREAK = _flag("\n")
STATS = ("log_words", "log_chars", "mean_word", "symbols", "upper", "digits", "bangs", "pipes", "stops", "breaks",
         "distinct", "stutter", "windows", "symbol_ends")
D = len(STATS)


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0, 1)
    return np.log((share + 0.005) / (1 - share + 0.005))


def document_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each row, transformed to be near normal: logarithms of
    sizes, logits of shares.  A text without words has sizes and shares 0."""
    n = len(offsets) - 1
    words, row, start, end = words_of(data, offsets, WORD_BYTES)
    start, end = start - row, end - row
    n_words = np.bincount(row, minlength=n)
    a, b = offsets[:-1], offsets[1:]
    chars = _counts(IS_CHAR, data, a, b)
    per_char = lambda t: _logit(_counts(t, data, a, b) / np.maximum(chars, 1))
    per_word = lambda v: _logit(v / np.maximum(n_words, 1))
    same = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) if len(words) > 1 \
        else np.zeros(0, dtype=np.int64)
    window, w_row = shingle_hashes(words, row, 3)
    hit = _repeated(mix(window + w_row.astype(np.uint64)))
    return np.stack([
        np.log1p(n_words), np.log1p(chars), np.minimum(chars / np.maximum(n_words, 1), 50),
        per_char(IS_SYMBOL), per_char(IS_UPPER), per_char(IS_DIGIT), per_char(IS_BANG), per_char(IS_PIPE),
        per_char(IS_STOP), per_word(_counts(IS_BREAK, data, a, b)),
        per_word(_distinct(mix(words + row.astype(np.uint64)), row, n) if len(words) else np.zeros(n)),
        per_word(np.bincount(row[same], minlength=n)), per_word(np.bincount(w_row[hit], minlength=n)),
        per_word(np.bincount(row, weights=IS_SYMBOL[data[end - 1]], minlength=n) if len(words) else np.zeros(n)),
    ], axis=1).astype(np.float64)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)`` per row, from whole texts."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            data, offsets = byte_rows(b.column(1))
            for i, j in row_blocks(offsets):
                x = document_stats(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["doc_id", "x"])

    return src.mapInArrow(run, "doc_id long, x array<double>")


def remainder(col: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds; null has none."""
    return F.crc32(F.col(col).cast("string")) % FOLDS


def held_out(col: str = "doc_id"):
    return F.coalesce(remainder(col) == HELD_OUT, F.lit(False))


class Discriminant:
    """Two Gaussians with shrunken covariances; ``score`` is the probability of
    class 1, from log-odds divided by ``temperature``."""

    temperature = 1.0

    def __init__(self, counts, sums, products, shrinkage: float = SHRINKAGE):
        self.counts = np.asarray(counts, dtype=np.float64)
        self.parts = None
        total = self.counts.sum()
        if (self.counts < 2).any():
            return
        mean = sum(sums) / total
        pooled = sum(products) / total - np.outer(mean, mean)
        self.centre, self.scale = mean, np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        within = np.zeros(D)
        parts = []
        for n, s, p in zip(self.counts, sums, products):
            m = s / n
            cov = (p / n - np.outer(m, m)) / np.outer(self.scale, self.scale)
            parts.append(((m - self.centre) / self.scale, cov))
            within += n / total * np.diag(cov)
        self.parts = []
        for n, (m, cov) in zip(self.counts, parts):
            shrunk = (1 - shrinkage) * cov + shrinkage * np.diag(within) + FLOOR * np.eye(D)
            chol = np.linalg.cholesky(shrunk)
            self.parts.append((m, np.linalg.inv(chol).T, 2 * np.log(np.diag(chol)).sum() - 2 * np.log(n / total)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [(((z - m) @ w) ** 2).sum(axis=1) + c for m, w, c in self.parts]
        return (d[0] - d[1]) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:  # a class is missing: its share is all that is known
            total = self.counts.sum()
            return np.full(len(x), self.counts[1] / total if total else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -700, 700)))


def _temperature(rows: DataFrame, models: dict[int, Discriminant], counts) -> float:
    """The temperature with the least log loss over ``rows(y, fold, x...)``, each
    scored by the model of the other folds; tasks add up, the driver gets a
    number for each temperature."""
    target = np.array([1 / (counts[0] + 2), (counts[1] + 1) / (counts[1] + 2)])

    def run(batches):
        loss = np.zeros(len(TEMPERATURES))
        for b in batches:
            y, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(D)], axis=1)
            for f, model in models.items():
                at = fold == f
                if model.parts is not None and at.any():
                    odds, p = model.log_odds(x[at]), target[y[at]]
                    loss += [(p * np.logaddexp(0, -odds / t) + (1 - p) * np.logaddexp(0, odds / t)).sum() for t in TEMPERATURES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss)), pa.int32()), pa.array(loss)], ["t", "loss"])

    got = rows.mapInArrow(run, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
    return TEMPERATURES[min(got, key=lambda r: (r["loss"], r["t"]))["t"]] if any(r["loss"] for r in got) else 1.0


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality",
        shrinkage: float = SHRINKAGE) -> Discriminant:
    """Moments of every labelled row outside the held-out fold in one aggregate,
    the temperature in another; the driver gets sums of two classes in three
    folds, whatever the number of documents."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = stats.where(~held_out()).join(known, "doc_id")
    rows = stored(rows.select("y", remainder().cast("int").alias("fold"), *[F.col("x")[i].alias(f"x{i}") for i in range(D)]),
                  "labelled-stats")
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    sums = rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)],
                                         *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    got = {(r["y"], r["fold"]): r for r in sums.collect()}

    def moments(without: int | None) -> Discriminant:
        counts, s, p = [0, 0], [np.zeros(D), np.zeros(D)], [np.zeros((D, D)), np.zeros((D, D))]
        for (y, fold), r in sorted(got.items()):
            if fold != without:
                counts[y] += r["n"]
                s[y] = s[y] + np.array([r[f"s{i}"] for i in range(D)])
                m = np.zeros((D, D))
                for i, j in pairs:
                    m[i, j] = m[j, i] = r[f"p{i}_{j}"]
                p[y] = p[y] + m
        return Discriminant(counts, s, p, shrinkage)

    model = moments(None)
    if model.parts is not None:
        model.temperature = _temperature(rows, {f: moments(f) for f in range(FOLDS) if f != HELD_OUT}, model.counts)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD,
                   shrinkage: float = SHRINKAGE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row.

    Null and empty texts are scored from their statistics like any other; a
    null id is never held out and never labelled; repeated rows are returned as
    they come and count as often in the fit; labels other than 0 and 1 are
    passed over.  If a class has fewer than two training rows, every score is
    the share of class 1 (0.5 without labels).  An empty table gives an empty
    table; other columns are not read.  Texts are read once; statistics are
    stored, and both the fit and the scores use them.
    """
    bounded_batches(docs.sparkSession)
    stats = stored(statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, label_col, shrinkage)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, D) if b.num_rows else np.zeros((0, D))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
