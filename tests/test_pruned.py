"""The pivot index returns the rows of the plain scan, and skips vectors."""
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import knn, pruned
from quarry.session import scratch_path

CORPUS = "id long, vec array<double>"
QUERIES = "qid long, qvec array<double>"


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "score").collect()))


def clustered(seed, n, dim=8, spots=12):
    rng = random.Random(seed)
    centres = [[rng.uniform(-50, 50) for _ in range(dim)] for _ in range(spots)]
    return [[x + rng.gauss(0, 0.5) for x in centres[rng.randrange(spots)]] for _ in range(n)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_rows_equal_the_plain_scan_and_vectors_are_skipped(spark, metric):
    corpus = spark.createDataFrame(list(enumerate(clustered(1, 3000))), CORPUS)
    queries = spark.createDataFrame([(k, v) for k, v in enumerate(clustered(1, 40))], QUERIES)
    path = pruned.build(corpus, scratch_path(spark, "pruned-test"), metric)
    for block in (None, 15):
        ranking, report = pruned.search(queries, path, 5, metric, block_rows=block)
        assert rows_of(ranking) == rows_of(knn.nearest(queries, corpus, 5, metric))
        told = report.first()
        assert told.pairs == 40 * 3000 == told.scored + told.skipped
        assert told.skipped > told.pairs / 2


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nulls_ties_widths_and_repeats(spark, metric):
    odd = [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [])]
    same = [(1000 + k, [1.0] * 8) for k in range(50)] + [(1000, [1.0] * 8)]
    corpus = spark.createDataFrame(list(enumerate(clustered(2, 60))) + odd + same, CORPUS)
    queries = spark.createDataFrame([(1, [1.0] * 8), (2, [0.0] * 8), (3, clustered(2, 1)[0]), (1, [1.0] * 8)], QUERIES) \
        .distinct()
    path = pruned.build(corpus, scratch_path(spark, "pruned-test"), metric, pivots=20)
    for k in (1, 7, 200):  # 200: more than there are
        got, _ = pruned.search(queries, path, k, metric)
        assert [r[:3] for r in rows_of(got)] == [r[:3] for r in rows_of(knn.nearest(queries, corpus, k, metric))]


def test_empty_tables_and_wrong_width(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0])], CORPUS)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], QUERIES)
    path = pruned.build(corpus, scratch_path(spark, "pruned-test"))
    assert pruned.search(queries.limit(0), path, 3)[0].count() == 0
    with pytest.raises(ValueError):
        pruned.search(spark.createDataFrame([(1, [1.0])], QUERIES), path, 3)
    nothing = pruned.build(corpus.limit(0), scratch_path(spark, "pruned-test"))
    ranking, report = pruned.search(queries, nothing, 3)
    assert ranking.count() == 0 and tuple(report.first()) == (0, 0, 0)


def test_a_small_index_is_searched_by_all_cores(spark):
    corpus = spark.createDataFrame(list(enumerate(clustered(3, 2000))), CORPUS)
    path = pruned.build(corpus, scratch_path(spark, "pruned-test"))
    files = spark.read.parquet(f"{path}/vectors").inputFiles()
    assert len(files) >= spark.sparkContext.defaultParallelism


def test_a_search_scores_few_pairs_exactly(monkeypatch):
    rng = np.random.default_rng(9)
    V, Q = rng.normal(size=(4000, 16)), rng.normal(size=(40, 16))
    P = V[:20]
    exact, scored = knn._pair_scores, []
    monkeypatch.setattr(knn, "_pair_scores", lambda r, *rest: (scored.append(len(r)), exact(r, *rest))[1])
    d = pruned._distances(V, P)
    at = np.lexsort((d.min(axis=1), d.argmin(axis=1)))
    rows = pa.RecordBatch.from_arrays([pa.array(at), pa.array(V[at].tolist()), pa.array(d.argmin(axis=1)[at].astype(np.int32)),
                                       pa.array(d.min(axis=1)[at])], ["id", "vec", "pivot", "dist"])
    out = pa.Table.from_batches(pruned._task(iter([rows]), np.arange(40), Q, P, 5, "l2", 6))
    want = pruned._distances(Q, V).argsort(axis=1)[:, :5]
    assert sorted(x for x in out["id"].to_pylist()[:-1]) == sorted(want.ravel().tolist())
    assert sum(scored) < 40 * 4000 / 10
