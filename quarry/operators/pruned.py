"""Exact nearest neighbours over a stored pivot index that skips vectors.

The index is the corpus with, for each vector, its nearest pivot and the
distance to it, sorted by both; pivots are a bounded sample of the corpus'
own vectors.  By the triangle inequality a vector at distance ``r`` from a
pivot is at least ``|d(q, pivot) - r|`` from a query, so a stretch of vectors
whose least such bound lies above the query's k-th best distance so far cannot
hold one of its neighbours and is not scored.  The k-th best distance starts as
that to the pivots, which are corpus vectors themselves.

Cosine is searched as the distance of unit vectors.  Results equal those of
:func:`knn.nearest`, ties included.  Whatever has no distance (null, of another
width, not finite, zero for cosine) has no pivot and is never skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn

PIVOTS = 256      # at most; the only part of the corpus that the driver holds
STRETCH = 256     # vectors that are scored or skipped together
_NO_ID = np.iinfo(np.int64).max


def _unit(V: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return V
    with np.errstate(divide="ignore", invalid="ignore"):
        return V / np.sqrt((V * V).sum(axis=1))[:, None]


def _distances(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Distances of all rows of A to all rows of B, by differences."""
    out = np.empty((len(A), len(B)))
    step = max(1, (1 << 20) // max(1, A.shape[1] * len(B)))
    for at in range(0, len(A), step):
        diff = A[at:at + step, None, :] - B[None, :, :]
        out[at:at + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _pivot_distances(U: np.ndarray, P: np.ndarray):
    """``(distances, error)`` of unit or plain vectors to the pivots by a matrix
    product, null where there is none; ``error`` bounds, per row, how far they
    are from the exact ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        un, pn = (U * U).sum(axis=1), (P * P).sum(axis=1)
        d = (-2.0 * U) @ P.T
        d += un[:, None]
        d += pn
        np.sqrt(np.maximum(d, 0, out=d), out=d)
    d[~np.isfinite(d)] = np.nan
    # |sqrt(x) - sqrt(y)| <= sqrt(|x - y|)
    return d, np.sqrt(4 * (U.shape[1] + 4) * np.finfo(np.float64).eps * (un + pn.max(initial=0)))


def build(corpus: DataFrame, path: str, metric: str = "l2", *, cid: str = "id", cvec: str = "vec",
          pivots: int = PIVOTS) -> str:
    """Write the index of ``corpus`` at ``path``: ``pivots`` (at most so many
    rows, those of least id hash) and ``vectors(id, vec, pivot, dist)``, range
    partitioned by pivot and distance, so a pivot that is near a third of all
    vectors is spread over many files.  Ids must be integral; the width is that
    of the first pivot.  An empty corpus gives an empty index."""
    if metric not in ("l2", "cosine"):
        raise ValueError(metric)
    spark = corpus.sparkSession
    c = corpus.select(F.col(cid).cast("long").alias("id"), F.col(cvec).cast("array<double>").alias("vec"))
    usable = F.size("vec") > 0
    usable &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if metric == "cosine":
        usable &= F.exists("vec", lambda x: x != 0)
    first = c.where(usable).orderBy(F.xxhash64("id"), "id", "vec").limit(pivots).collect()
    first = [r for r in first if len(r.vec) == len(first[0].vec)]
    spark.createDataFrame([(k, r.id, r.vec) for k, r in enumerate(first)], "pivot int, id long, vec array<double>") \
        .coalesce(1).write.parquet(f"{path}/pivots")
    P = _unit(np.array([r.vec for r in first], dtype=np.float64), metric) if first else np.zeros((0, 0))

    def assign(batches):
        for b in batches:
            V, ok = knn._matrix(b.column(1), P.shape[1])
            with np.errstate(invalid="ignore", over="ignore"):
                d = _distances(_unit(V, metric), P) if len(P) else np.full((len(V), 1), np.nan)
            d[~ok] = np.nan
            d[~np.isfinite(d)] = np.nan
            none = np.isnan(d).any(axis=1)
            d[none] = 0
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at.astype(np.int32), mask=none),
                 pa.array(d[np.arange(len(d)), at], mask=none)], ["id", "vec", "pivot", "dist"])

    rows = c.mapInArrow(assign, "id long, vec array<double>, pivot int, dist double")
    # a search works on pairs, so small files are worth a task: the count is not left to adaptive execution
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (rows.repartitionByRange(ranges, "pivot", "dist", F.xxhash64("id")).sortWithinPartitions("pivot", "dist")
     .write.parquet(f"{path}/vectors"))
    return path


def _needed(stretches, at, dist, pd, bound, error, digits):
    """``(lo, hi, queries)`` of the stretches that some query needs; neighbouring
    ones that all queries need are one, up to ``knn.GROUP_ROWS`` vectors."""
    nq = len(bound)
    held = None
    for lo, hi in stretches:
        q = np.arange(nq)
        if at[lo] >= 0:
            d, r = pd[at[lo]], dist[lo:hi]
            least = np.maximum(d - r.max(), r.min() - d)
            # slack for rounding: of the distances, and of the scores that are compared
            slack = error + 1e-9 * (1 + np.abs(d) + r.max()) + np.sqrt(2 * 10.0 ** -digits)
            q = np.flatnonzero(~(least > bound + slack))
        if held and (len(q) < nq or hi - held[0] > knn.GROUP_ROWS):
            yield *held, np.arange(nq)
            held = None
        if len(q) == nq:
            held = (held[0] if held else lo, hi)
        elif len(q):
            yield lo, hi, q
    if held:
        yield *held, np.arange(nq)


def _task(batches, qids, Q, P, k, metric, digits):
    """The best ``k`` per query among a task's vectors, and a last row with a
    null qid whose id is how many scores were computed."""
    nq, dim = Q.shape
    qn = np.sqrt((Q * Q).sum(axis=1))
    pd, error = _pivot_distances(_unit(Q, metric), P)  # a query without distances skips nothing
    bound = np.full(nq, np.inf)
    if len(P) >= k:
        bound = np.partition(np.where(np.isnan(pd), np.inf, pd), k - 1, axis=1)[:, k - 1] + error
    pd = np.ascontiguousarray(pd.T)
    top = knn.Top(nq, k)
    scored = 0
    for b in batches:
        at = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
        dist = b.column(3).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(at)) + 1
        stretches = [(lo, min(lo + STRETCH, end)) for start, end in zip([0, *cuts], [*cuts, len(at)])
                     for lo in range(start, end, STRETCH)]
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        V, ok = knn._matrix(b.column(1), dim)
        for lo, hi, q in _needed(stretches, at, dist, pd, bound, error, digits):
            scored += len(q) * (hi - lo)
            knn.add_vectors(top, Q, qn, ids[lo:hi], V[lo:hi], ok[lo:hi], metric, digits, rows=None if len(q) == nq else q)
            last = top.key[q].max(axis=1)
            far = np.sqrt(np.maximum(last if metric == "l2" else 2 + 2 * last, 0))
            bound[q] = np.minimum(bound[q], far)
    yield from knn.emit(top, qids)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([scored], pa.int64()),
                                      pa.array([None], pa.float64())], ["qid", "id", "score"])


def search(queries: DataFrame, path: str, k: int, metric: str = "l2", *, qid: str = "qid", qvec: str = "qvec",
           digits: int = 6, limit_bytes: int = knn.DEFAULT_BROADCAST_LIMIT,
           block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(ranking, report)``: the ranking is ``(qid, id, score, rank)`` as of
    :func:`knn.nearest`, the report one row ``(pairs, scored, skipped)``.

    ``metric`` must be the one the index was built with.  Pivots that no query
    of a pass can need are left out by a filter on the stored column, the rest
    is skipped in the tasks.  Query tables above ``limit_bytes`` (what a task
    holds for them, distances to the pivots included) take several passes.
    Candidates are written to the shared folder, so both results read them."""
    spark: SparkSession = queries.sparkSession
    found = spark.read.schema("pivot int, id long, vec array<double>").parquet(f"{path}/pivots").orderBy("pivot").collect()
    vectors = spark.read.schema("id long, vec array<double>, pivot int, dist double").parquet(f"{path}/vectors")
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).cast("array<double>").alias("qvec"))
    nq, dim = knn._query_stats(q)
    width = len(found[0].vec) if found else dim
    if nq and width != dim:
        raise ValueError(f"queries have width {dim}, the index {width}")
    P = _unit(np.array([r.vec for r in found], dtype=np.float64).reshape(len(found), width), metric)
    # one row per pivot
    reach = {r.pivot: r for r in vectors.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    schema = "qid long, id long, score double"

    def over(qids, Q):
        pd, error = _pivot_distances(_unit(Q, metric), P)
        bound = np.partition(np.where(np.isnan(pd), np.inf, pd), k - 1, axis=1)[:, k - 1] if len(P) >= k \
            else np.full(len(Q), np.inf)
        slack = 2 * error + 1e-6 * (1 + np.abs(np.nan_to_num(pd)).max(initial=0)) + np.sqrt(2 * 10.0 ** -digits)
        need = [p for p, r in reach.items() if p is not None
                and not (np.maximum(pd[:, p] - r.hi, r.lo - pd[:, p]) > bound + slack).all()]
        rows = vectors
        if len(need) < sum(p is not None for p in reach):
            rows = vectors.where(F.col("pivot").isNull() | F.col("pivot").isin(need))
        shared = spark.sparkContext.broadcast((qids, Q, P))
        return rows.mapInArrow(lambda batches: _task(batches, *shared.value, k, metric, digits), schema)

    own = knn.bytes_per_query(dim, k)
    found_rows = knn._in_passes(q, k, limit_bytes * own // (own + 8 * len(P)), block_rows, over, schema, "pruned")
    out = knn.scratch_path(spark, "pruned-candidates")
    found_rows.write.parquet(out)
    cands = spark.read.schema(schema).parquet(out)
    ranking = knn._final_rank(cands.where("qid is not null"), k, metric)
    pairs = nq * sum(r.n for r in reach.values())
    report = cands.where("qid is null").agg(F.coalesce(F.sum("id"), F.lit(0)).alias("scored")).select(
        F.lit(pairs).cast("long").alias("pairs"), "scored", (F.lit(pairs).cast("long") - F.col("scored")).alias("skipped"))
    return ranking, report
