"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, the overall label last.  Each
model is a ridge-penalised logistic regression on vocabulary terms (present or
not, and their share of the words) and on the log-odds that the earlier models
gave; in training these are out-of-fold predictions, so a later model sees
earlier ones as they will be on new texts.

Terms are words and word beginnings, since an inflected language shows a stem
in many forms; they are chosen from the training rows by their association
with the overall label.  Only this label is given; the categories before it are weak
labels: a toxic document with one of the category's seed words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, stored
from .decontam import fold

SAMPLE_ROWS = 6000  # labelled documents that the fit may use, half of them toxic if there are as many
VOCABULARY = 120
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings, in characters
FOLDS = 5
RIDGE = 0.1
THRESHOLD = 0.2
MIN_DOCS = 5

# fixed values: seed words of the weak categories, in chain order
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile"),
    "contempt": ("pathetic", "worthless", "disgusting", "useless", "shameful"),
    "dehumanising": ("scum", "trash", "vermin", "filth", "garbage", "parasite"),
}
OVERALL = "toxic"
CHAIN = (*SEEDS, OVERALL)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Newton steps; the last weight is the intercept, which is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _log_odds(x, w):
    return np.clip(np.hstack([x, np.ones((len(x), 1))]) @ w, -30, 30)


class Terms:
    """Vocabulary lookup: a term that ends in ``*`` is a word beginning."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        raw = [t.encode() for t in terms]
        self.words = {t: k for k, t in enumerate(raw) if not t.endswith(b"*")}
        self.starts = {t[:-1]: k for k, t in enumerate(raw) if t.endswith(b"*")}
        self.lengths = sorted({len(t) for t in self.starts})
        self.heads = frozenset(t[:3] for t in [*self.words, *self.starts])

    def vector(self, text: bytes) -> np.ndarray:
        """For each term: 1 if present, then its share of the words (times 25, at most 1)."""
        words = fold(text)
        counts = np.zeros(len(self.terms))
        heads = self.heads
        for w in words:
            if w[:3] in heads:
                k = self.words.get(w)
                if k is not None:
                    counts[k] += 1
                for n in self.lengths:
                    k = self.starts.get(w[:n]) if n <= len(w) else None
                    if k is not None:
                        counts[k] += 1
        return np.concatenate([counts > 0, np.minimum(25 * counts / max(1, len(words)), 1)])

    def vectors(self, texts) -> np.ndarray:
        return np.array([self.vector(t) for t in texts], dtype=np.float64).reshape(-1, 2 * len(self.terms))


class Chain:
    """``weights``: one vector per category, on terms and earlier log-odds."""

    def __init__(self, terms: Terms, weights: list[np.ndarray]):
        self.terms, self.weights = terms, weights

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, in chain order."""
        out = []
        for w in self.weights:
            z = _log_odds(x, w)
            out.append(_sigmoid(z))
            x = np.hstack([x, z[:, None] / 10])
        return np.stack(out, axis=1) if len(x) else np.zeros((0, len(self.weights)))


def fit_chain(terms: Terms, x: np.ndarray, labels: np.ndarray, fold_of: np.ndarray, ridge: float = RIDGE) -> Chain:
    """``labels``: one column per category in chain order; ``fold_of``: 0..FOLDS-1 per row."""
    weights = []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        out_of_fold = np.zeros(len(y))
        for f in range(FOLDS):
            inside = fold_of != f
            if (~inside).any():
                out_of_fold[~inside] = _log_odds(x[~inside], logistic(x[inside], y[inside], ridge))
        weights.append(logistic(x, y, ridge))
        x = np.hstack([x, out_of_fold[:, None] / 10])
    return Chain(terms, weights)


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                   sample_rows: int) -> DataFrame:
    """``(id, y, text)`` of the sampled labelled documents.  The sample is
    bounded (least hash first, per class), so its ids may be broadcast; an id
    that comes many times does not widen it."""
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    half = [ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2) for y in (0, 1)]
    picked = half[0].unionByName(half[1])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(picked), "id")
    once = rows.groupBy("id", "y", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))
    return once.select("id", "y", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def choose_terms(rows: DataFrame, vocabulary: int) -> list[str]:
    """Words and beginnings most associated with the label, by the difference
    of their document rates in both classes over its spread."""
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def run(batches):
        for b in batches:
            words = [sorted({w.decode("utf-8", "replace") for w in fold(t.as_py())}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["y", "words"])

    words = rows.select("y", "text").mapInArrow(run, "y int, words array<string>")
    starts = [F.transform(F.filter("words", lambda w, k=k: F.char_length(w) >= k),
                          lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]
    found = words.select("y", F.explode(F.array_union(F.col("words"), F.array_distinct(F.concat(*starts)))).alias("term"))
    a, b = F.col("hits"), F.col("docs") - F.col("hits")
    pooled = (a + b + 1) / (n + 2)
    strength = F.abs(a / max(1, toxic) - b / max(1, n - toxic)) / F.sqrt(pooled * (1 - pooled))
    top = (found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("y").alias("hits"))
           .where(F.col("docs") >= MIN_DOCS).orderBy(strength.desc(), "term").limit(8 * vocabulary).collect())
    chosen: list = []
    for r in sorted(top, key=lambda r: -len(r.term)):  # beginnings found in the same documents say nothing new
        if not any((r.docs, r.hits) == (o.docs, o.hits) and o.term.startswith(r.term.rstrip("*")) for o in chosen):
            chosen.append(r)
    keep = {r.term for r in chosen}
    return [r.term for r in top if r.term in keep][:vocabulary]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = OVERALL, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY,
          ridge: float = RIDGE) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled documents (whole texts);
    the driver collects their term vectors, not their texts."""
    bounded_batches(docs.sparkSession)
    rows = stored(training_texts(docs, labels, id_col, text_col, label_col, sample_rows)
                  .orderBy(F.xxhash64("id"), "id", "y", "text").limit(sample_rows), "toxic-sample")
    seeds = {w for ws in SEEDS.values() for w in ws}
    terms = Terms(sorted({*choose_terms(rows, vocabulary), *seeds}))

    def run(batches):
        for b in batches:
            x = terms.vectors([t.as_py() for t in b.column(2)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    found = sorted(rows.mapInArrow(run, "id long, y int, x binary").collect(), key=lambda r: (r.id, r.y, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, dtype=np.float32) for r in found], dtype=np.float64) \
        .reshape(len(found), 2 * len(terms.terms))
    y = np.array([r.y for r in found], dtype=np.float64)
    weak = [y * (x[:, [terms.words[w.encode()] for w in ws]].sum(axis=1) > 0) for ws in SEEDS.values()]
    folds = np.array([zlib.crc32(str(r.id).encode()) % FOLDS for r in found], dtype=np.int64)
    chain = fit_chain(terms, x, np.stack([*weak, y], axis=1).reshape(len(found), len(CHAIN)), folds, ridge)
    # the sample may hold more toxic rows than the labels do: set the overall model's base rate right
    all_rows = labels.where(F.col(label_col).isin(0, 1)).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(label_col), F.lit(0))).first()
    odds = [(t + 0.5) / (k - t + 0.5) for k, t in (all_rows, (len(y), y.sum()))]
    chain.weights[-1][-1] += np.log(odds[0] / odds[1])
    return chain


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_<category>..., toxic_score, toxic)`` for each row, from the
    whole text; ``toxic`` is true from ``threshold`` on.

    Null and empty texts have no terms and get the intercepts' score; null and
    repeated ids are returned as they come; an empty table gives an empty
    table; other columns are not read.  Without labels of both classes the
    score is the (smoothed) share of toxic labels.  One scan, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in SEEDS]

    def run(batches):
        for b in batches:
            p = np.concatenate([np.zeros((0, len(CHAIN))), *[
                chain.probabilities(chain.terms.vectors([t.as_py() for t in b.column(1).slice(k, 1024)]))
                for k in range(0, b.num_rows, 1024)]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(p[:, k]) for k in range(len(CHAIN))], pa.array(p[:, -1] >= threshold)],
                ["doc_id", *names, "toxic_score", "toxic"])

    return src.mapInArrow(run, f"doc_id {kind}, {', '.join(n + ' double' for n in names)}, toxic_score double, toxic boolean")
