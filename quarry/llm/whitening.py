"""Embedding whitening: leading components of a covariance by FEAST.

Spark reduces the vectors to one covariance matrix; its leading eigenvectors
come from contour integration on that matrix:

1. Inertia counts (how many eigenvalues lie above a shift, from the signs of a
   Sturm sequence) and bisection give intervals around the wanted eigenvalues,
   with gaps at their ends.
2. A quadrature over a circle around an interval adds up solves with the complex
   shifted covariance.  Applied to a few vectors that filter keeps the directions
   of the interval and damps all others.
3. Rayleigh-Ritz in the filtered space gives eigenvalues and vectors.  Steps 2
   and 3 repeat until the residuals are at rounding level.
4. The inertia counts at an interval's ends must differ by the number of
   eigenvalues found in it: none is missed.

The whole corpus is read four times (distinct vectors, sums, covariance, the
check of the result) and once for its rows; the driver holds matrices of
dimension x dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, stored

COMPONENTS = 4
STEPS = 256               # steps of a unit interval that entries are rounded down to
NODES = 8                 # quadrature nodes on the upper half of the circle
BLOCK_VALUES = 1 << 18    # entries of one block of vectors in a task
MAX_DIMENSION = 4096      # a matrix of this size squared is held by the driver
MAX_ROUNDS = 40


# ---------------------------------------------------------------- FEAST on one matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal matrix that Householder
    reflections turn symmetric ``a`` into (its eigenvalues are the same)."""
    a = np.array(a, dtype=np.float64)
    for k in range(len(a) - 2):
        x = a[k + 1:, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        p = a[k + 1:, k + 1:] @ v
        p -= v * (v @ p)
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(np.linalg.norm(x), x[0])
        a[k + 2:, k] = a[k, k + 2:] = 0
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Inertia: how many eigenvalues are above ``shift``, the positive pivots of
    the shifted tridiagonal matrix."""
    above, pivot = 0, 1.0
    tiny = np.finfo(float).tiny
    for k, d in enumerate(diagonal):
        pivot = d - shift - (off[k - 1] * (off[k - 1] / pivot) if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def leading_intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` of disjoint intervals that hold the ``wanted``
    greatest eigenvalues, falling.  Bisection on inertia counts finds these and
    the next one; eigenvalues that agree to about eight digits share an interval,
    whose ends lie within the gaps around it."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    bottom, top = float((diagonal - reach).min()), float((diagonal + reach).max())
    scale = max(abs(bottom), abs(top), np.finfo(float).tiny)
    bottom, top = bottom - 1e-3 * scale, top + 1e-3 * scale

    def eigenvalue(k: int) -> float:  # the k-th greatest, from 1
        lo, hi = bottom, top
        while lo < (mid := (lo + hi) / 2) < hi:
            if count_above(diagonal, off, mid) >= k:
                lo = mid
            else:
                hi = mid
        return (lo + hi) / 2

    found = [eigenvalue(1)]
    clusters = [[0, 1]]
    while True:
        k = len(found)
        if k < n:
            found.append(eigenvalue(k + 1))
            if found[k - 1] - found[k] <= 1e-8 * scale:
                clusters[-1][1] = k + 1
                continue
        if k >= wanted:
            break
        clusters.append([k, k + 1])
    out = []
    for i, j in clusters:
        above = found[i - 1] - found[i] if i else np.inf
        below = found[j - 1] - found[j] if j < len(found) else np.inf
        gap = min(above, below, scale)
        low, high = found[j - 1] - gap / 2, found[i] + gap / 2
        out.append((low, high, count_above(diagonal, off, low) - count_above(diagonal, off, high)))
    return out


def filtered(m: np.ndarray, low: float, high: float, count: int, nodes: int, rng) -> np.ndarray:
    """Orthonormal basis of the eigenvectors of ``m`` whose eigenvalues lie
    between ``low`` and ``high``: contour quadrature and Rayleigh-Ritz in turn."""
    n = len(m)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * np.pi / 2 * (1 + x))
    q = np.linalg.qr(rng.standard_normal((n, min(n, count + max(4, count // 2)))))[0]
    for _ in range(MAX_ROUNDS):
        # nodes of the upper half circle; the lower half adds the conjugates
        y = sum(w_k * np.real(radius * z * np.linalg.solve((centre + radius * z) * np.eye(n) - m, q)) for w_k, z in zip(w, turns)) / 2
        q = np.linalg.qr(y)[0]
        values, small = np.linalg.eigh(q.T @ m @ q)
        q = q @ small
        residual = np.linalg.norm(m @ q - q * values, axis=0)
        good = (values > low) & (values < high) & (residual <= 64 * np.finfo(float).eps * n ** 0.5)
        if good.sum() == count:
            return q[:, good]
    raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, {good.sum()} were found")


def feast(a: np.ndarray, wanted: int, above: float = -np.inf, nodes: int = NODES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of symmetric ``a`` that exceed
    ``above``, falling, and their unit eigenvectors as columns.  Raises if an
    interval's eigenvectors are not as many as its inertia counts say."""
    a = (a + a.T) / 2
    n = len(a)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    m = a / scale
    diagonal, off = tridiagonal(m)
    wanted = min(wanted, n if above == -np.inf else count_above(diagonal, off, above / scale))
    if wanted <= 0:
        return np.zeros(0), np.zeros((n, 0))
    rng = np.random.default_rng(seed)
    parts = [filtered(m, low, high, count, nodes, rng) for low, high, count in leading_intervals(diagonal, off, wanted)]
    # one Rayleigh-Ritz over all intervals makes their vectors orthogonal too
    q = np.linalg.qr(np.hstack(parts))[0]
    values, small = np.linalg.eigh(q.T @ m @ q)
    return values[::-1][:wanted] * scale, (q @ small[:, ::-1])[:, :wanted]


# ---------------------------------------------------------------- passes over the vectors

def whole_steps(embedding: str, steps: int = STEPS):
    """``floor(steps * c)`` of each entry as a long."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * steps).cast("long") + F.lit(0).cast("long"))


def _usable(embedding: str):
    c = F.col(embedding)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(c.isNotNull() & finite, F.lit(False))


def _blocks(batch: pa.RecordBatch, column: int, d: int):
    """Vectors of a batch as matrices of bounded size, with their first row."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, d)
    step = max(1, BLOCK_VALUES // d)
    for k in range(0, len(rows), step):
        yield k, rows[k:k + step]


def _matrix_sum(vectors: DataFrame, d: int, make, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all vectors of ``make(block of vectors)``, added up per task and
    then per cell; the driver gets one matrix of ``shape``."""
    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            for _, rows in _blocks(b, 0, d):
                total += make(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = vectors.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros(shape)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


class Whitening:
    """A fitted transform: count and sums of the distinct vectors, leading
    eigenvalues and components, and the error of the whitened covariance."""

    def __init__(self, n, sums, values, vectors, trace, identity_error=0.0):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.identity_error = identity_error

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-step vectors."""
        return (rows - self.sums / self.n) @ self.vectors / np.sqrt(self.values)


def prepare(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = STEPS) -> DataFrame:
    """``(vec_id, x array<long>)`` of the rows whose vector has entries, all of
    them finite."""
    src = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    return src.where(_usable("embedding") & (F.size("embedding") > 0)).select("vec_id", whole_steps("embedding", steps).alias("x"))


def fit(prepared: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector once; None without vectors.  Components
    whose eigenvalue is zero to rounding are left out."""
    distinct = stored(prepared.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d, n = sizes.d, sizes.n
    if d > MAX_DIMENSION:
        raise ValueError(f"{d} dimensions; the driver holds matrices of {MAX_DIMENSION} at most")
    distinct = distinct.where(F.size("x") == d)
    wide = [F.sum(F.get("x", F.lit(k)).cast("decimal(28,0)")).alias(f"s{k}") for k in range(d)]
    sums = np.array([int(s) for s in distinct.agg(*wide).first()], dtype=object)
    mean = (sums / n).astype(np.float64)
    scatter = _matrix_sum(distinct, d, lambda rows: (lambda c: c.T @ c)(rows - mean), (d, d)) / n
    trace = float(np.trace(scatter))
    values, vectors = feast(scatter, components, above=np.finfo(float).eps * d * trace)
    out = Whitening(n, sums, values, vectors, trace)
    k = len(values)
    if k:
        # the result's covariance, centred by its own mean
        plain = Whitening(n, mean * n, out.values, out.vectors, out.trace)
        middle = _matrix_sum(distinct, d, lambda rows: plain.project(rows).sum(axis=0)[None, :], (1, k))[0] / n
        spread = _matrix_sum(distinct, d, lambda rows: (lambda c: c.T @ c)(plain.project(rows) - middle), (k, k)) / n
        out.identity_error = float(np.abs(spread - np.eye(k)).max())
    return out


def _deviation(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """``sum (n * x - S)^2`` exactly; null where a long cannot hold it."""
    most = n * max(abs(int(rows.max())), abs(int(rows.min()))) + max(abs(int(s)) for s in sums)
    if most * most * len(sums) < 1 << 63:
        off = rows * np.int64(n) - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = ((rows.astype(object) * n - sums) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def transform(prepared: DataFrame, fitted: Whitening | None) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``, a row for each vector and component."""
    kind = prepared.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    if fitted is None or not len(fitted.values):
        prepared, d = prepared.where(F.lit(False)), 1
        fitted = Whitening(1, np.zeros(1, dtype=object), np.zeros(0), np.zeros((1, 0)), 1.0)
    d, n, sums = len(fitted.sums), fitted.n, fitted.sums
    plain = Whitening(n, (sums / n).astype(np.float64) * n, fitted.values, fitted.vectors, fitted.trace)

    def run(batches):
        for b in batches:
            for k, rows in _blocks(b, 1, d):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, len(rows)), pa.array(_deviation(rows, n, sums), pa.int64()),
                     pa.array(list(plain.project(rows)), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    # the fit's numbers are literals: dimensions x components of them
    explained = [float(v / fitted.trace) for v in fitted.values]
    shares = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    out = prepared.where(F.size("x") == d).select("vec_id", "x").mapInArrow(run, schema)
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("k")).alias("explained"),
                    F.lit(float(fitted.identity_error)).alias("identity_error")))


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """Whitened coordinates of every usable vector on the leading components.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, and so are rows of another length than most distinct vectors have
    (the longer in a tie).  Null and repeated ids are returned as they come;
    repeated vectors count once in the fit.  Fewer components come out where the
    covariance has fewer eigenvalues above rounding (none for a single vector);
    components of one repeated eigenvalue are any orthonormal basis.  An entry
    beyond the range of long counts as its end.  A deviation that a long cannot
    hold is null.  An empty table gives an empty table; other columns are not read.
    """
    bounded_batches(embeddings.sparkSession)
    prepared = prepare(embeddings, id_col, vector_col, steps)
    return transform(prepared, fit(prepared, components))
