"""Quality rules: a linear-chain conditional random field labels each line as
content or boilerplate, and the content share decides retention.

The model is trained here by regularised maximum likelihood (forward-backward
gradients) on a bounded sample of labelled documents, whose lines take their
document's quality as label; its prior mean is a plain set of weights, which is
also the model when there are no labels.  Every text is then decoded whole by
Viterbi.  Statistics of a block of texts are computed with NumPy on its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, byte_rows, mix, prefix_hash, row_blocks, shingle_hashes, span_hash, words_of

SAMPLE_DOCS = 2000      # labelled documents that the fit may use
SAMPLE_SEGMENTS = 4000  # and segments of their lines
SEGMENT_LINES = 64
MIN_WORDS = 50
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1

FEATURES = ("bias", "log_chars", "symbol_share", "upper_share", "digit_share", "bang_share", "pipe_share",
            "mean_word", "repeat_share", "duplicate", "ends_sentence", "few_words", "window_share")
# prior mean of the boilerplate score of each feature
PRIOR = np.array([-1.5, -0.3, 12.0, 1.5, 2.0, 6.0, 10.0, 0.0, 2.5, 1.0, -0.5, 0.3, 3.0])
PRIOR_STAY = 0.8
STRENGTH = 10.0  # weight of the prior against the sample

SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[0] = 0xFF  # a byte that UTF-8 does not use: NUL is part of a word
WORD_BYTES[SPACES] = 0


def _flag(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    t[[ord(c) for c in chars]] = 1
    return t


IS_SYMBOL = _flag("#*$%&|<>")
IS_UPPER = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
IS_DIGIT = _flag("0123456789")
IS_BANG = _flag("!")
IS_PIPE = _flag("|")
IS_CHAR = np.ones(256, dtype=np.uint8)  # first byte of a code point that is no white space
IS_CHAR[0x80:0xC0] = 0
IS_CHAR[SPACES] = 0
ENDS = _flag(".!?")


def _counts(table, data, start, end):
    c = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(table[data], out=c[1:])
    return c[end] - c[start]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks keys that come twice or more."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each of n owners has (keys differ by owner)."""
    _, first = np.unique(keys, return_index=True)
    return np.bincount(of[first], minlength=n)


def block_stats(data: np.ndarray, offsets: np.ndarray) -> dict:
    """Base statistics of each row, and a feature matrix of its lines with a word."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    words, row, w_start, w_end = words_of(data, offsets, WORD_BYTES)
    w_start, w_end = w_start - row, w_end - row  # back to places in data
    # lines: each row ends one, and so does each \n
    breaks = np.flatnonzero(data == 0x0A)
    l_end = np.concatenate([breaks, offsets[1:]])
    l_next = np.concatenate([breaks + 1, offsets[1:]])
    l_row = np.concatenate([np.searchsorted(offsets[1:], breaks, side="right"), np.arange(n)])
    order = np.lexsort((l_end, l_row))
    l_end, l_next, l_row = l_end[order], l_next[order], l_row[order]
    first = np.ones(len(l_row), dtype=bool)
    first[1:] = l_row[1:] != l_row[:-1]
    l_start = np.where(first, offsets[l_row], np.concatenate([[0], l_next[:-1]]))
    # words to lines: a line's key is its row, then its place
    w_line = np.searchsorted(l_start + l_row, w_start + row, side="right") - 1
    l_words = np.bincount(w_line, minlength=len(l_row)).astype(np.int64)
    raw = prefix_hash(data)
    l_key = mix(span_hash(raw, l_start, l_end) + l_row.astype(np.uint64))
    with_word = l_words > 0
    keep = np.flatnonzero(with_word)
    _, inverse = np.unique(l_key[keep], return_inverse=True)
    seen = np.full(inverse.max() + 1 if len(keep) else 0, len(keep))
    np.minimum.at(seen, inverse, np.arange(len(keep)))
    duplicate = seen[inverse] < np.arange(len(keep))
    # words in repeated three-word windows of their row
    window, w_row = shingle_hashes(words, row, 3)
    hit = _repeated(mix(window + w_row.astype(np.uint64)))
    in_row = np.flatnonzero(row[:-2] == row[2:]) if len(words) > 2 else np.zeros(0, dtype=np.int64)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[in_row[hit] + k] = True
    # lines' features
    s, e = l_start[keep], l_end[keep]
    chars = np.maximum(_counts(IS_CHAR, data, s, e), 1)
    lw = l_words[keep]
    kept_no = np.cumsum(with_word) - 1
    w_kept = kept_no[w_line] if len(words) else np.zeros(0, dtype=np.int64)
    distinct = _distinct(mix(words + w_line.astype(np.uint64)), w_kept, len(keep)) if len(words) else np.zeros(0)
    last_word = np.zeros(len(keep), dtype=np.int64)
    last_word[w_kept] = w_end
    share = lambda t: _counts(t, data, s, e) / chars
    feats = np.stack([
        np.ones(len(keep)), np.log1p(chars) / 5, share(IS_SYMBOL), share(IS_UPPER), share(IS_DIGIT), share(IS_BANG),
        share(IS_PIPE), np.minimum(chars / np.maximum(lw, 1), 50) / 10, 1 - distinct / np.maximum(lw, 1),
        duplicate, ENDS[data[last_word - 1]] if len(keep) else np.zeros(0), lw < 5,
        np.bincount(w_kept, weights=covered, minlength=len(keep)) / np.maximum(lw, 1)], axis=1).astype(np.float64)
    by_row = lambda v, r: np.bincount(r, weights=v, minlength=n).astype(np.int64)
    rows = np.arange(n)
    return {
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "word_chars": _counts(IS_CHAR, data, offsets[rows], offsets[rows + 1]),
        "n_symbols": _counts(IS_SYMBOL, data, offsets[rows], offsets[rows + 1]),
        "n_dup_lines": by_row(duplicate.astype(float), l_row[keep]),
        "n_repeat_words": by_row(covered.astype(float), row),
        "line_row": l_row[keep], "line_chars": chars, "features": feats, "lens": lens,
    }


# ---------------------------------------------------------------- the field

class Field:
    """``weights``: boilerplate score of each feature; ``moves[a, b]``: score of
    b following a."""

    def __init__(self, weights=PRIOR, moves=None):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.moves = np.eye(2) * PRIOR_STAY if moves is None else np.asarray(moves, dtype=np.float64)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels of one text's lines, from their boilerplate scores; ties go to content."""
        if not scores:
            return []
        (cc, cb), (bc, bb) = self.moves.tolist()
        c, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_c, from_b = c + cb, b + bb
            c_c, b_c = c + cc, b + bc
            back.append((0 if c_c >= b_c else 1, 0 if from_c >= from_b else 1))
            c, b = max(c_c, b_c), max(from_c, from_b) + s
        label = 0 if c >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def log_likelihood(weights, moves, x, y, mask):
    """Log-likelihood of padded sequences x[n, t, f], labels y[n, t], and its gradients."""
    n, t, _ = x.shape
    score = np.zeros((n, t, 2))
    score[:, :, 1] = x @ weights
    fwd = np.zeros((n, t, 2))
    bwd = np.zeros((n, t, 2))
    fwd[:, 0] = score[:, 0]
    for k in range(1, t):
        step = np.logaddexp(fwd[:, k - 1, 0, None] + moves[0], fwd[:, k - 1, 1, None] + moves[1]) + score[:, k]
        fwd[:, k] = np.where(mask[:, k, None], step, fwd[:, k - 1])
    for k in range(t - 2, -1, -1):
        nxt = bwd[:, k + 1] + score[:, k + 1]
        step = np.logaddexp(moves[:, 0] + nxt[:, 0, None], moves[:, 1] + nxt[:, 1, None])
        bwd[:, k] = np.where(mask[:, k + 1, None], step, bwd[:, k + 1])
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * mask
    gold = (score[:, :, 1] * y * mask).sum()
    pair_mask = mask[:, 1:]
    g_moves = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint = np.exp(fwd[:, :-1, a] + moves[a, b] + score[:, 1:, b] + bwd[:, 1:, b] - z[:, None]) * pair_mask
            seen = ((y[:, :-1] == a) & (y[:, 1:] == b) & pair_mask).sum()
            g_moves[a, b] = seen - joint.sum()
            gold += seen * moves[a, b]
    g_weights = np.einsum("ntf,nt->f", x, (y * mask - p))
    return gold - z.sum(), g_weights, g_moves


def fit_field(segments: list[tuple[int, np.ndarray]], rounds: int = 80) -> Field:
    """Maximum a posteriori by Adam; ``segments``: (label, features[t, f])."""
    if not segments or len({y for y, _ in segments}) < 2:
        return Field()
    t = max(len(f) for _, f in segments)
    x = np.zeros((len(segments), t, len(FEATURES)))
    mask = np.zeros((len(segments), t), dtype=bool)
    for k, (_, f) in enumerate(segments):
        x[k, :len(f)] = f
        mask[k, :len(f)] = True
    y = np.repeat(np.array([[lab] for lab, _ in segments]), t, axis=1)
    theta = np.concatenate([PRIOR, (np.eye(2) * PRIOR_STAY).ravel()])
    prior = theta.copy()
    # lines of one document share its label, so the chain's own weights keep close to their prior
    hold = np.concatenate([np.full(len(PRIOR), 1.0), np.full(4, 50.0)]) * STRENGTH
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        _, gw, gm = log_likelihood(theta[:-4], theta[-4:].reshape(2, 2), x, y, mask)
        g = (np.concatenate([gw, gm.ravel()]) - hold * (theta - prior)) / len(segments)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_docs: int = SAMPLE_DOCS, sample_segments: int = SAMPLE_SEGMENTS) -> Field:
    """Fit on at most ``sample_docs`` labelled ids (least hash first) and
    ``sample_segments`` segments of up to 64 lines of their whole texts; both
    bounds hold whatever the corpus, so the sample may be broadcast and
    collected."""
    bounded_batches(docs.sparkSession)
    picked = (labels.where("quality is not null and doc_id is not null")
              .select(F.col("doc_id").cast("long").alias("id"), (1 - F.col("quality")).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id", "y").limit(sample_docs))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(F.broadcast(picked), "id")

    def run(batches):
        for b in batches:
            data, offsets = byte_rows(b.column(1))
            ids, ys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, j in row_blocks(offsets):
                s = block_stats(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                out = []
                bounds = np.searchsorted(s["line_row"], np.arange(j - i + 1))
                for k in range(j - i):
                    for at in range(bounds[k], bounds[k + 1], SEGMENT_LINES):
                        f = s["features"][at:min(at + SEGMENT_LINES, bounds[k + 1])]
                        out.append((ids[i + k], int(at - bounds[k]), ys[i + k],
                                    f.astype(np.float32).ravel().tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.float32()))],
                        ["id", "at", "y", "f"])

    rows = (texts.mapInArrow(run, "id long, at long, y int, f array<float>")
            .orderBy(F.xxhash64("id", "at"), "id", "at", "y", F.xxhash64("f")).limit(sample_segments).collect())
    return fit_field([(r.y, np.array(r.f).reshape(-1, len(FEATURES))) for r in rows])


# ---------------------------------------------------------------- decisions

def decide(data: np.ndarray, offsets: np.ndarray, field: Field, share: float = CONTENT_SHARE) -> dict:
    """Base statistics, line labels by Viterbi, and the verdict of each row."""
    s = block_stats(data, offsets)
    n = len(offsets) - 1
    scores = s["features"] @ field.weights
    bounds = np.searchsorted(s["line_row"], np.arange(n + 1))
    labels = np.zeros(len(scores), dtype=np.int64)
    listed = scores.tolist()
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            labels[a:b] = field.viterbi(listed[a:b])
    content = np.bincount(s["line_row"], weights=s["line_chars"] * (labels == CONTENT), minlength=n)
    s["n_content_lines"] = np.bincount(s["line_row"], weights=labels == CONTENT, minlength=n).astype(np.int64)
    s["content_share"] = content / np.maximum(s["word_chars"], 1)
    s["base_failed"] = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    s["kept"] = ~s["base_failed"] & (s["content_share"] >= share)
    return s


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
                  share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: its base statistics, ``base_failed``, ``kept``,
    and the lines and share that the field marks as content.

    Null and empty texts have no words, so they fail the base rules.  Lines
    without a word are passed over.  Null and repeated ids are returned as they
    come, an empty table gives an empty table, other columns are not read.  One
    scan, no shuffle; memory follows the longest single text.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = byte_rows(b.column(1))
            for i, j in row_blocks(offsets):
                s = decide(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], field, share)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *[pa.array(s[c], pa.int64()) for c in LONGS],
                     pa.array(s["base_failed"]), pa.array(s["kept"]),
                     pa.array(s["n_content_lines"], pa.int64()), pa.array(s["content_share"])],
                    ["doc_id", *LONGS, "base_failed", "kept", "n_content_lines", "content_share"])

    return src.mapInArrow(run, f"doc_id {kind}, {', '.join(c + ' long' for c in LONGS)}, base_failed boolean, "
                               "kept boolean, n_content_lines long, content_share double")


def keep_quality(docs: DataFrame, field: Field, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            data, offsets = byte_rows(b.column(place))
            kept = [decide(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], field, share)["kept"]
                    for i, j in row_blocks(offsets)]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
