"""The negative Manhattan distance as a relatedness function for :mod:`knn`.

It has no matrix product.  ``approximate`` and ``screen`` add small integers
instead of doubles (four times as many in a vector register).  ``approximate``
says how far it may be off; ``screen`` compares its sums with what the search
asks for while they are in the cache and names the pairs that may reach it.  The
search then asks ``pairs`` for their exact values.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64, 2048  # queries x vectors whose sums stay in a core's cache


def pairs(Q: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Of row ``i`` of one to row ``i`` of the other."""
    return -np.abs(Q - V).sum(axis=1)


def similarity(Q: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Of all rows of Q to all rows of V."""
    return np.stack([pairs(x, V) for x in Q]) if len(Q) else np.zeros((0, len(V)))


def approximate(Q: np.ndarray, V: np.ndarray):
    """``(similarities, error)``: none is further than ``error`` from the exact
    one.  Entries are cut to whole numbers below ``levels`` of one step each, and
    ``|a - b| = 2 max(a, b) - a - b``."""
    dim = V.shape[1]
    levels = min(511, 32767 // max(1, dim))
    lo = min(Q.min(initial=np.inf), V.min(initial=np.inf))
    span = max(Q.max(initial=-np.inf), V.max(initial=-np.inf)) - lo
    if levels < 16 or not 0 < span < np.inf:
        return similarity(Q, V), 0.0
    step = span / levels
    a, b = (np.clip(np.floor((x.T - lo) / step), 0, levels).astype(np.int16) for x in (Q, V))
    a_sum, b_sum = a.sum(axis=0, dtype=np.int32), b.sum(axis=0, dtype=np.int32)
    out = np.empty((len(Q), len(V)))
    for i in range(0, len(Q), _BLOCK[0]):
        for j in range(0, len(V), _BLOCK[1]):
            x, y = a[:, i:i + _BLOCK[0]], np.ascontiguousarray(b[:, j:j + _BLOCK[1]])
            larger = np.zeros((x.shape[1], y.shape[1]), dtype=np.int16)  # dim * levels fit
            one = np.empty_like(larger)
            for d in range(dim):
                np.maximum(y[d], x[d][:, None], out=one)
                larger += one
            sums = a_sum[i:i + _BLOCK[0], None] + b_sum[j:j + _BLOCK[1]]
            np.multiply(sums - 2 * larger.astype(np.int32), step, out=out[i:i + _BLOCK[0], j:j + _BLOCK[1]])
    # a cut entry is less than a step below its own; the rest is rounding
    return out, dim * step * (1 + 1e-9) + 1e-9 * dim * (abs(lo) + span)


def _rounded(V: np.ndarray, kind, levels: int, group: int):
    """``near`` of :func:`screen` with entries rounded to ``levels`` whole numbers
    over the range of ``V``; ``group`` of them add up within ``kind``.

    What rounding took from a row, or how far it lies outside, is known, so
    ``distance >= outside + step * sum|a - b| - lost(query) - lost(vector)``, and
    ``sum|a - b| = 2 sum max(a, b) - sum a - sum b``.
    """
    dim = V.shape[1]
    lo, hi = V.min(), V.max()
    step = (hi - lo) / levels
    wide = np.int16 if dim * (levels + 1) <= 32767 else np.int32

    def whole(x):
        n = np.rint((x - lo) / step)
        return n.astype(kind), n.sum(axis=0), np.abs(x - (lo + step * n)).sum(axis=0)

    b, b_sum, b_lost = whole(V.T)
    half = np.ceil((b_sum + b_lost / step) / 2).astype(wide)

    def near(Q, least):
        inside = np.clip(Q.T, lo, hi)
        a, a_sum, a_lost = whole(inside)
        with np.errstate(over="ignore", invalid="ignore"):
            outside = np.abs(Q.T - inside).sum(axis=0)
            slack = 1e-9 * (dim * (abs(lo) + hi - lo) + outside + np.abs(least))
            most = np.ceil(((a_lost - least - outside + slack) / step + a_sum) / 2)
        ends = np.iinfo(wide)
        most = np.clip(np.where(np.isnan(most), ends.max, most), ends.min, ends.max).astype(wide)
        hit = np.empty((len(Q), len(V)), dtype=bool)
        for j in range(0, len(V), _BLOCK[1]):
            y = np.ascontiguousarray(b[:, j:j + _BLOCK[1]])
            for i in range(0, len(Q), _BLOCK[0]):
                x = a[:, i:i + _BLOCK[0], None]
                larger = np.repeat(-half[None, j:j + _BLOCK[1]], x.shape[1], axis=0)
                one, some = np.empty(larger.shape, kind), np.empty(larger.shape, kind)
                for d in range(0, dim, group):
                    np.maximum(y[d], x[d], out=some)
                    for e in range(d + 1, min(d + group, dim)):
                        np.maximum(y[e], x[e], out=one)
                        some += one
                    larger += some
                np.less_equal(larger, most[i:i + _BLOCK[0], None], out=hit[i:i + _BLOCK[0], j:j + _BLOCK[1]])
        return hit

    return near


def screen(V: np.ndarray):
    """``near(Q, least) -> (rows, columns)`` of all pairs whose similarity may be
    at least the query's ``least``, by row: sums of bytes, and of larger whole
    numbers where too many pairs lie within their error."""
    with np.errstate(over="ignore"):
        span = V.max(initial=-np.inf) - V.min(initial=np.inf)
    if not 1e-300 < span < np.inf:
        return lambda Q, least: np.nonzero(similarity(Q, V) >= least[:, None])
    coarse = _rounded(V, np.uint8, 63, 4)

    def near(Q, least):
        hit = coarse(Q, least)
        if hit.sum() > hit.size // 16 and np.isfinite(least).all():
            hit = _rounded(V, np.int16, 511, 1)(Q, least)
        return np.divmod(np.flatnonzero(hit.ravel()), len(V))

    return near


similarity.approximate = approximate
similarity.screen = screen
similarity.pairs = pairs
