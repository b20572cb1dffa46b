import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import knn, manhattan
from quarry.plans.queries import QUERIES


def frames(spark, corpus_rows, query_rows):
    c = spark.createDataFrame(corpus_rows, "id long, vec array<double>")
    q = spark.createDataFrame(query_rows, "qid long, qvec array<double>")
    return q, c


def test_zero_vector_is_null_and_last(spark):
    q, c = frames(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])], [(0, [1.0, 0.0])])
    rows = knn.nearest(q, c, 5).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1]
    assert rows[1].score is None


def test_ties_break_by_lower_id(spark):
    q, c = frames(spark, [(7, [1.0, 1.0]), (3, [1.0, 1.0]), (5, [0.0, 1.0])], [(0, [1.0, 1.0])])
    rows = knn.nearest(q, c, 2).orderBy("rank").collect()
    assert [r.id for r in rows] == [3, 7]


def test_k_larger_than_corpus(spark):
    q, c = frames(spark, [(1, [1.0]), (2, [2.0]), (3, [3.0])], [(0, [0.0])])
    assert knn.nearest(q, c, 5, "l2").count() == 3


def test_empty_corpus_gives_no_rows(spark):
    q, c = frames(spark, [], [(0, [1.0, 0.0])])
    assert knn.nearest(q, c, 5).count() == 0


def test_broadcast_and_blocked_paths_agree(spark):
    rng = np.random.default_rng(3)
    corpus = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(25)]
    q, c = frames(spark, corpus, queries)
    c = c.repartition(4)
    for metric in ("cosine", "l2"):
        a = knn.nearest(q, c, 5, metric).select("qid", "rank", "id").collect()
        b = knn.nearest(q, c, 5, metric, broadcast_limit_bytes=0,
                        query_block_rows=7).select("qid", "rank", "id").collect()
        assert sorted(a) == sorted(b)


def test_numpy_scores_equal_column_functions(spark):
    rng = np.random.default_rng(5)
    corpus = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    q, c = frames(spark, corpus, [(0, corpus[0][1])])
    got = {r.id: r.score for r in knn.nearest(q, c, 40, "l2").collect()}
    ref = (c.crossJoin(q).select("id", F.round(V.l2_squared("vec", "qvec"), 6).alias("d"))
           .collect())
    for r in ref:
        assert got[r.id] == pytest.approx(r.d, abs=1e-6)


def test_score_stats(spark):
    q, c = frames(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], [(0, [1.0, 0.0])])
    r = knn.score_stats(q, c).first()
    assert (r.n_scored, r.max_score, r.min_score) == (2, 1.0, 0.0)


def test_cosine_column_function(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    vals = [r.c for r in df.select(V.cosine("a", "b").alias("c")).collect()]
    assert vals[0] is None and vals[1] == pytest.approx(1.0)


def test_pluggable_similarity(spark):
    q, c = frames(spark, [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 5.0])], [(0, [1.0, 1.0])])
    neg_manhattan = lambda Q, Vm: -np.abs(Q[:, None, :] - Vm[None, :, :]).sum(axis=2)
    rows = knn.nearest(q, c, 3, neg_manhattan).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 2, 3]
    assert rows[0].score == -1.0


def test_a_task_emits_k_rows_per_query_whatever_its_batches(spark):
    rng = np.random.default_rng(11)
    vecs = rng.integers(0, 3, size=(400, 4)).astype(float)  # many ties
    qids, q = np.arange(10), rng.normal(size=(10, 4))
    whole = None
    for size in (400, 40, 7, 1):
        batches = [pa.RecordBatch.from_arrays(
            [pa.array(range(a, min(400, a + size))), pa.array(vecs[a:a + size].tolist())], ["id", "vec"])
            for a in range(0, 400, size)]
        for metric in ("cosine", "l2"):
            qn = np.sqrt((q * q).sum(axis=1))
            out = pa.Table.from_batches(knn._partition_topk(iter(batches), qids, q, qn, 5, metric, 6, "id", "vec", 4))
            assert out.num_rows == 50
            got = sorted(zip(out["qid"].to_pylist(), out["id"].to_pylist()))
            whole = whole or {}
            assert whole.setdefault(metric, got) == got


def test_l2_of_close_vectors_far_from_the_origin(spark):
    near = [1e5 + 1e-3, 1e5, 1e5]
    q, c = frames(spark, [(1, [1e5] * 3), (2, near), (3, [1e5 + 2e-3, 1e5, 1e5])], [(0, [1e5] * 3)])
    rows = knn.nearest(q, c, 3, "l2", digits=9).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(1, 0.0), (2, pytest.approx(1e-6, rel=1e-3)), (3, pytest.approx(4e-6, rel=1e-3))]
    s = knn.score_stats(q, c, "l2", digits=9).first()
    assert s.min_score == 0.0 and s.max_score == pytest.approx(4e-6, rel=1e-3)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_both_paths_treat_nulls_and_nothing_alike(spark, limit):
    q, c = frames(spark, [(1, [1.0, 0.0]), (2, None), (3, [1.0])], [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    rows = knn.nearest(q, c, 5, broadcast_limit_bytes=limit).collect()
    assert sorted((r.qid, r.id, r.score) for r in rows if r.score is not None) == [(0, 1, 1.0), (1, 1, 0.0)]
    assert len(rows) == 6
    for bad in ([(0, [1.0, 0.0]), (1, None)], [(0, [1.0, 0.0]), (1, [1.0])]):
        q2, _ = frames(spark, [], bad)
        with pytest.raises(ValueError):
            knn.nearest(q2, c, 5, broadcast_limit_bytes=limit)
        with pytest.raises(ValueError):
            knn.score_stats(q2, c, broadcast_limit_bytes=limit)
    nothing = c.limit(0)
    assert knn.nearest(q, nothing, 5, broadcast_limit_bytes=limit).count() == 0
    assert sorted(tuple(r) for r in knn.score_stats(q, nothing, broadcast_limit_bytes=limit).collect()) == [
        (0, 0, None, None), (1, 0, None, None)]


def test_score_stats_blocked_path_agrees(spark):
    rng = np.random.default_rng(2)
    corpus = [(i, rng.normal(size=5).tolist()) for i in range(120)] + [(999, [0.0] * 5)]
    queries = [(i, rng.normal(size=5).tolist()) for i in range(9)]
    q, c = frames(spark, corpus, queries)
    a = sorted(knn.score_stats(q, c).collect())
    b = sorted(knn.score_stats(q, c, broadcast_limit_bytes=0, query_block_rows=4).collect())
    assert a == b and all(r.n_scored == 120 for r in a)


def test_blocked_path_with_empty_slices(spark):
    q, c = frames(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(i, [1.0, float(i)]) for i in range(5)])
    a = sorted(knn.nearest(q, c, 1).select("qid", "id").collect())
    b = sorted(knn.nearest(q, c, 1, broadcast_limit_bytes=0, query_block_rows=2).select("qid", "id").collect())
    assert a == b and len(a) == 5


def test_passes_are_bounded_by_bytes_that_include_k(spark, monkeypatch):
    rng = np.random.default_rng(8)
    q = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)], "qid long, qvec array<double>")
    c = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)], "id long, vec array<double>")
    held, scan = [], knn._scan
    monkeypatch.setattr(knn, "_scan", lambda c, qids, *rest: (held.append(len(qids)), scan(c, qids, *rest))[1])
    whole = sorted(knn.nearest(q, c, 20, "l2").collect())
    assert held == [200] and len(whole) == 4000
    for k, limit in ((20, 60_000), (5, 60_000)):
        held.clear()
        got = sorted(knn.nearest(q, c, k, "l2", broadcast_limit_bytes=limit).collect())
        assert got == [r for r in whole if r.rank <= k]
        assert sum(held) == 200 and len(held) > 1 and max(held) * knn.bytes_per_query(8, k) <= limit
    assert knn.bytes_per_query(64, 100) > 10 * 64  # with a large k the ranking, not the vector, is what counts


def test_the_corpus_is_never_shuffled(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    plan = knn.nearest(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" in plan and "Exchange" not in below
    rows = knn._partition_topk(iter([pa.RecordBatch.from_pydict({"id": [5, 6], "vec": [[1.0, 0.0], [0.0, 1.0]]})]),
                               np.arange(100_000), np.ones((100_000, 2)), np.full(100_000, 2 ** 0.5), 2, "l2", 6, "id", "vec", 2)
    sizes = [b.num_rows for b in rows]
    assert sum(sizes) == 200_000 and max(sizes) <= knn.EMIT_ROWS  # candidates leave in bounded batches


def test_a_corpus_no_larger_than_the_queries_goes_round_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = [[float(x) for x in rng.integers(0, 4, 6)] for _ in range(150)] + [None, [1.0], [0.0] * 6]  # many ties
    c = spark.createDataFrame(list(enumerate(vecs)) + [(3, vecs[3])], "id long, vec array<double>")
    q = spark.createDataFrame(list(enumerate(vecs[:150])) + [(k, vecs[2]) for k in range(150, 180)] + [(7, vecs[9])],
                              "qid long, qvec array<double>")
    for metric in ("cosine", "l2", manhattan.similarity):
        for k in (4, 200):
            whole = sorted(map(str, knn.nearest(q, c, k, metric).select("qid", "rank", "id", "score").collect()))
            with monkeypatch.context() as m:
                m.setattr(knn, "_scan", None)  # no task sends its own candidates
                got = knn.nearest(q, c, k, metric, broadcast_limit_bytes=4000)
                assert sorted(map(str, got.select("qid", "rank", "id", "score").collect())) == whole
    once = knn.nearest(q.where("qid <> 7"), c, 4, broadcast_limit_bytes=4000)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()  # nothing is ranked again


def test_sort_relatedness_ranks_the_whole_corpus(spark, tmp_path):
    """More vectors than any top n keeps, in order, with ties by id."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], 0) for i in range(130)]
    rows[7] = (7, [0.0] * 4, 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    V = np.array([r[1] for r in rows])
    n = np.sqrt((V * V).sum(axis=1))
    with np.errstate(invalid="ignore"):
        s = np.round(V @ V.T / np.outer(n, n), 6)
    want = {q: sorted(range(130), key=lambda i: (np.isnan(s[q, i]), -s[q, i] if s[q, i] == s[q, i] else 0, i)) for q in range(130)}
    got = {}
    for r in QUERIES["sort_relatedness"](spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
        assert r.rank == len(got[r.qid])
        assert r.score == pytest.approx(s[r.qid, r.id], abs=1e-6) if r.score is not None else np.isnan(s[r.qid, r.id])
    assert got == want


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_a_whole_ranking_is_that_of_nearest_without_a_cut(spark, limit):
    rng = np.random.default_rng(6)
    vecs = [[float(x) for x in rng.integers(0, 4, 6)] for _ in range(70)] + [None, [1.0], [0.0] * 6]  # many ties
    c = spark.createDataFrame([*enumerate(vecs), (3, vecs[3]), (-4, vecs[8])], "id long, vec array<double>")
    q = spark.createDataFrame([*enumerate(vecs[:20]), (7, vecs[9])], "qid long, qvec array<double>")
    for metric in ("cosine", "l2", manhattan.similarity):
        whole = sorted(map(str, knn.nearest(q, c, 200, metric).select("qid", "rank", "id", "score").collect()))
        got = knn.ranking(q, c, metric, broadcast_limit_bytes=limit)
        assert sorted(map(str, got.select("qid", "rank", "id", "score").collect())) == whole
        assert len(whole) == 21 * 75
    assert knn.ranking(q, c.limit(0), broadcast_limit_bytes=limit).count() == 0
    assert knn.ranking(q.limit(0), c, broadcast_limit_bytes=limit).count() == 0
    last = knn.ranking(q.limit(1), c.unionByName(c.where("id = 5").selectExpr("cast(null as long) id", "vec")),
                       broadcast_limit_bytes=limit).where("id is null").collect()
    assert len(last) == 1  # an id may be null; it follows those of its score
    with pytest.raises(ValueError):
        knn.ranking(q.unionByName(q.limit(1).selectExpr("qid", "cast(null as array<double>) qvec")), c)


def test_a_ranking_of_a_broadcast_corpus_shuffles_no_pair(spark):
    c = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, vec array<double>")
    plan = knn.ranking(c.toDF("qid", "qvec"), c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "Window" not in plan


def test_rows_are_sorted_alike_as_integers_and_as_floats():
    rng = np.random.default_rng(1)
    key = np.round(rng.normal(size=(5, 400)), 2)
    key[:, ::9] = np.inf
    for k in (key, key * 1e14, key[:, :1]):
        assert (knn._in_order(k, 2) == np.argsort(k, axis=1, kind="stable")).all()


def test_only_pairs_near_the_best_are_scored_exactly(monkeypatch):
    rng = np.random.default_rng(6)
    V, Q = rng.normal(size=(9000, 16)), rng.normal(size=(50, 16))
    exact, scored = knn._pair_scores, []
    monkeypatch.setattr(knn, "_pair_scores", lambda r, *rest: (scored.append(len(r)), exact(r, *rest))[1])
    for metric in ("l2", "cosine", manhattan.similarity):
        scored.clear()
        top = knn.Top(len(Q), 5)
        for lo in range(0, 9000, 3000):
            knn.add_vectors(top, Q, np.sqrt((Q * Q).sum(axis=1)), np.arange(lo, lo + 3000), V[lo:lo + 3000], np.ones(3000, dtype=bool), metric, 6)
        assert top.have.all() and sum(scored) < 50 * 9000 / 50
        if callable(metric):
            best = np.argsort(-np.round(metric(Q, V), 6), axis=1, kind="stable")[:, :5]
            assert (np.sort(top.ids, axis=1) == np.sort(best, axis=1)).all()


@pytest.mark.parametrize("dim", [1, 3, 64, 3000])
def test_approximate_manhattan_is_within_its_error(dim):
    rng = np.random.default_rng(dim)
    for Q, V in ((rng.normal(size=(9, dim)), rng.normal(size=(70, dim)) * 5 + 100), (np.ones((2, dim)), np.ones((3, dim)))):
        got, error = manhattan.approximate(Q, V)
        want = -np.abs(Q[:, None, :] - V[None, :, :]).sum(axis=2)
        assert np.allclose(manhattan.similarity(Q, V), want) and np.abs(got - want).max() <= error + 1e-9


@pytest.mark.parametrize("dim", [1, 3, 64, 600])
def test_screen_names_every_pair_that_may_be_among_the_best(dim):
    rng = np.random.default_rng(dim)
    Q, V = rng.normal(size=(9, dim)), rng.normal(size=(2100, dim))
    wild = V.copy()
    wild[3] *= 1e6  # one vector takes the whole grid
    for Q, V in ((Q, V), (Q * 9 + 50, V), (Q, wild), (Q, np.round(V)), (Q, np.ones((3, dim))), (Q, V[:0])):
        want = manhattan.similarity(Q, V) if len(V) else np.zeros((len(Q), 0))
        for least in (np.full(len(Q), -np.inf), np.sort(want, axis=1)[:, -5] if want.shape[1] > 5 else np.full(len(Q), -1e9)):
            r, c = manhattan.screen(V)(Q, least)
            assert (np.diff(r) >= 0).all()
            assert not set(zip(*np.nonzero(want >= least[:, None]))) - set(zip(r, c))


def test_screened_ranking_equals_brute_force_whatever_the_scale():
    rng = np.random.default_rng(8)
    V = np.concatenate([rng.normal(size=(3000, 8)), np.repeat(rng.normal(size=(5, 8)), 40, axis=0), np.zeros((2, 8))])
    for scale, shift in ((1.0, 0.0), (1.0, 1e4), (1e-3, 0.0), (1e16, 0.0), (300.0, -40.0)):
        W = V * scale + shift
        Q = W[::50]
        for metric in ("l2", "cosine", manhattan.similarity):
            n = np.sqrt((W * W).sum(axis=1))
            with np.errstate(all="ignore"):
                s = {"l2": lambda: ((Q[:, None] - W[None]) ** 2).sum(axis=2),
                     "cosine": lambda: np.einsum("id,jd->ij", Q, W) / (n[::50, None] * n)}.get(metric, lambda: metric(Q, W))()
            key = np.where(np.isfinite(s), np.round(s, 6) * (1 if metric == "l2" else -1), np.inf)
            top = knn.Top(len(Q), 7)
            for lo in range(0, len(W), 1500):
                knn.add_vectors(top, Q, n[::50], np.arange(lo, min(lo + 1500, len(W))), W[lo:lo + 1500],
                                np.ones(len(W[lo:lo + 1500]), dtype=bool), metric, 6)
            assert np.allclose(np.sort(top.key, axis=1), np.sort(key, axis=1)[:, :7], rtol=1e-12, atol=2e-6)


def test_screening_holds_no_double_of_each_pair():
    import tracemalloc
    rng = np.random.default_rng(2)
    V = rng.normal(size=(8192, 64))
    V /= np.sqrt((V * V).sum(axis=1, keepdims=True))
    Q, n, ok = V[:2048], np.ones(2048), np.ones(4096, dtype=bool)
    for metric in ("l2", "cosine", manhattan.similarity):
        top = knn.Top(len(Q), 5)
        knn.add_vectors(top, Q, n, np.arange(4096), V[:4096], ok, metric, 6)
        tracemalloc.start()
        knn.add_vectors(top, Q, n, np.arange(4096, 8192), V[4096:], ok, metric, 6)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # beside the block itself, which some of its forms double
        assert peak < 8 * knn._CELLS_PER_STEP + 2 * V[4096:].nbytes
